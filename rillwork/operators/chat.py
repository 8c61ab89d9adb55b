"""Chat statistics: totals, senders, gifts, words and rate series, all by partial aggregation.

A message is (seq, ts, user_id, kind, value, meta); gifts are the kinds in
GIFT_KINDS, weighted by their count in the metadata, one at least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GIFT_KINDS = ("purchase", "signup")
# Words that don't count, in English and Chinese, and chat expressions.
STOP_WORDS = tuple(
    """
    the a an is are was were be been being have has had do does did will would could should may might must shall can need dare to of in for on with at by
    from as into through during before after above below between under again further then once here there when where why how all each few more most other
    some such no nor not only own same so than too very just and but if or because until while this that these those it its he she they them his her their
    what which who whom 的 了 是 在 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 lol lmao haha hehe xd gg ez wp 666 233 哈哈 呵呵 嘿嘿
    """.split()
)


def micros(ts: Column) -> Column:
    """Microseconds from 1970 on, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def bucket(us: Column, width_s: int) -> Column:
    """Start of the bucket in seconds, truncated toward zero."""
    return F.call_function("div", us, F.lit(1_000_000 * width_s)) * width_s


def messages(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("seq"),
        micros(F.col("ts")).alias("us"),
        "user_id",
        F.col("event_type").alias("kind"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def is_gift() -> Column:
    return F.col("kind").isin(*GIFT_KINDS)


def weight() -> Column:
    return F.greatest(F.coalesce(F.col("k"), F.lit(1)), F.lit(1)).cast("long")


def totals(msgs: DataFrame) -> DataFrame:
    """Total, gift and chat counts, distinct senders, and the span in seconds from the first arrival."""
    span = F.greatest(F.lit(0), F.expr("(max(us) - min_by(us, seq)) div 1000000"))
    return msgs.agg(F.count("*").alias("total"), F.count_if(is_gift()).alias("gifts"), F.count_if(~is_gift()).alias("chats"), F.countDistinct("user_id").alias("senders"), span.cast("long").alias("duration_s"))


def rate(msgs: DataFrame, width_s: int) -> DataFrame:
    return msgs.groupBy(bucket(F.col("us"), width_s).alias("bucket_s")).agg(F.count("*").alias("n"))


def rate_gap_filled(msgs: DataFrame, width_s: int) -> DataFrame:
    """Every bucket from the first to the last, empty ones with 0; the gap after each bucket is filled beside it, so nothing is joined."""
    series = rate(msgs, width_s).withColumn("next_s", F.coalesce(F.lead("bucket_s").over(Window.orderBy("bucket_s")), F.col("bucket_s") + width_s))
    filled = series.withColumn("at_s", F.explode(F.expr(f"sequence(bucket_s, next_s - {width_s}, {width_s}L)")))
    return filled.select(F.col("at_s").alias("bucket_s"), F.when(F.col("at_s") == F.col("bucket_s"), F.col("n")).otherwise(0).cast("long").alias("n"))


def rate_peak_by(msgs: DataFrame, width_s: int, every: int) -> DataFrame:
    """Of each ``every`` buckets the fullest, the earliest of equals."""
    series = rate(msgs, width_s).withColumn("part", F.expr(f"bucket_s div {width_s * every}"))
    return series.groupBy("part").agg(F.max("n").alias("n"), F.max_by("bucket_s", F.struct("n", -F.col("bucket_s"))).alias("bucket_s"))


def top(counted: DataFrame, key: str, n: int) -> DataFrame:
    return counted.orderBy(F.desc("n"), key).limit(n)


def talkers(msgs: DataFrame) -> DataFrame:
    return msgs.groupBy("user_id").agg(F.count("*").alias("n"))


def gifters(msgs: DataFrame) -> DataFrame:
    return msgs.filter(is_gift()).groupBy("user_id").agg(F.sum(weight()).alias("n"))


def gift_tally(msgs: DataFrame) -> DataFrame:
    return msgs.filter(is_gift()).groupBy("kind").agg(F.count("*").alias("gifts"), F.sum(weight()).alias("n"))


def unicode_words(texts: DataFrame, *by: str, extra_stop_words: tuple[str, ...] = ()) -> DataFrame:
    """How often each word of two characters or more occurs, in lower case, stop words left out.

    Words are runs of what Unicode calls alphabetic or numeric.  There is no
    dictionary for Chinese and Japanese: a run without separators is one word.
    """
    word = F.explode(F.split(F.coalesce("text", F.lit("")), r"[^\p{IsAlphabetic}\p{N}]+"))
    found = texts.select(*by, word.alias("word")).filter(F.length("word") >= 2).withColumn("word", F.lower("word"))
    return found.filter(~F.col("word").isin(*STOP_WORDS, *extra_stop_words)).groupBy(*by, "word").agg(F.count("*").alias("n"))


def session_summary(msgs: DataFrame, width_s: int = 3600) -> DataFrame:
    """One row for each kind: messages, senders, the top talker and the rate's peak.

    Users and buckets are counted first, so no kind's messages meet in one task.
    """
    by_user = msgs.groupBy("kind", "user_id").agg(F.count("*").alias("n"))
    by_bucket = msgs.groupBy("kind", bucket(F.col("us"), width_s).alias("bucket_s")).agg(F.count("*").alias("n"))
    users = by_user.groupBy("kind").agg(F.sum("n").alias("total"), F.count("*").alias("senders"), F.max_by("user_id", F.struct("n", -F.col("user_id"))).alias("top_talker"), F.max("n").alias("top_count"))
    peaks = by_bucket.groupBy("kind").agg(F.max("n").alias("peak"))
    return users.join(peaks, "kind")
