"""Schedules in zones, bounded summaries, words by a dictionary, and media tags, over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.functions import bytes as B
from rillwork.operators import chat, hitters, repair, schedules, words
from rillwork.operators.machines import walked

from .registry import joined, query, table

_DAYS = ("Mon", "Wed", "Sat")


def _times(events: DataFrame) -> DataFrame:
    return events.select("event_id", chat.micros(F.col("ts")).alias("us"))


# the events are of one winter, in which Berlin is an hour ahead
@query(
    "events",
    "with t as (select event_id, epoch_us(ts) us, epoch_us(ts) + 3600000000 l from events), d as (select *, l // 86400000000 as day, l % 86400000000 s from t), "
    "w as (select *, (day + 4) % 7 in (1, 3, 6) today, (day + 3) % 7 in (1, 3, 6) before from d), "
    "n as (select event_id, min((day + k) * 86400000000 + 81000000000 - 3600000000) opens from w, range(0, 8) r(k) where (day + k + 4) % 7 in (1, 3, 6) and (day + k) * 86400000000 + 81000000000 - 3600000000 > us group by 1) "
    "select w.event_id, case when today then s >= 81000000000 or s < 9900000000 else before and s < 9900000000 end inside, opens, "
    "case when case when today then s >= 81000000000 or s < 9900000000 else before and s < 9900000000 end then (case when today then day + 1 else day end) * 86400000000 + 9900000000 - 3600000000 end closes from w left join n using (event_id)",
)
def window_edges_zoned(events: DataFrame) -> DataFrame:
    return schedules.window_edges(_times(events), "us", _DAYS, "22:30", "02:45", "Europe/Berlin").drop("us")


@query(
    "events",
    "with t as (select event_id, epoch_us(ts) // 60000000 m from events), a as (select unnest(range((select min(m) from t), (select max(m) + 8 * 1440 + 2 from t))) m), "
    "h as (select m, (m - 300) % 60 % 15 = 0 or (m - 300) % 60 in (1, 2) as mi, (m - 300) // 60 % 24 between 6 and 9 hr, ((m - 300) // 1440 + 4) % 7 in (1, 2, 5) wd from a), x as (select m, mi and hr and wd hit from h), "
    "y as (select m, hit, min(case when hit then m end) over (order by m rows between 1 following and unbounded following) nm, min(case when not hit then m end) over (order by m rows between 1 following and unbounded following) nu from x) "
    "select event_id, hit matches, case when nm - t.m <= 11520 then nm * 60000000 + 30000000 end next_match, case when hit and nu - t.m <= 11520 then nu * 60000000 end next_unmatch from t join y on y.m = t.m",
)
def cron_edges_zoned(events: DataFrame) -> DataFrame:
    return schedules.cron_edges(_times(events), "us", "30 */15,1-2 6-9 * * Mon,Tue,Fri", "America/New_York").drop("us")


@query("events", "select cast(user_id as varchar) talker, count(*) n, cast(0 as bigint) error from events group by 1 order by 2 desc, 1 limit 50")
def talkers_bounded(events: DataFrame) -> DataFrame:
    """Exact while there are fewer users than counters."""
    found = hitters.heavy_hitters(events.select(F.col("user_id").cast("string").alias("talker")), "talker", 100_000)
    return found.orderBy(F.desc("n"), "talker").limit(50)


@query("events", None)
def gifters_bounded(events: DataFrame) -> DataFrame:
    """Through 64 counters, fewer than there are users: counts with their errors."""
    gifts = chat.messages(events).filter(chat.is_gift()).withColumn("weight", chat.weight())
    return hitters.heavy_hitters(gifts, "user_id", 64, "weight")


@query("documents", None)
def word_hitters_bounded(documents: DataFrame) -> DataFrame:
    """Words of all documents through 20,000 counters in each task."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+")
    return hitters.heavy_hitters(documents.select(F.filter(words, lambda w: F.length(w) >= 2).alias("word")), "word", 20_000).limit(200)


@query("events", None)
def kind_hitters_daily(events: DataFrame) -> DataFrame:
    """The top three users of each kind, given every day."""
    return walked(chat.messages(events), "kind", ["us", "seq"], hitters.Hitters("us", "user_id", None, 500, 3, 86_400_000_000), "us")


@joined(None)
def words_by_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in ideographs without spaces, one for each Latin letter, cut by the words of all documents."""
    han = "".join(chr(0x4E00 + 37 * i) for i in range(26))
    letters = "abcdefghijklmnopqrstuvwxyz"
    written = lambda c: F.translate(F.lower(c), letters, han)
    docs = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("word"))
    dictionary = docs.filter("length(word) between 2 and 12").groupBy(written(F.col("word")).alias("word")).agg(F.count("*").alias("n")).filter("n >= 5")
    texts = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(written(F.col("text")), " +", "").alias("text"))
    return words.segmented_words(texts, dictionary)


_BODY = "select event_id, case when event_type in ('view', 'purchase') then 9 when event_type = 'click' then 8 else 18 end kind, (cast(props->>'$.k' as bigint) * 37 + event_id) % 256 b0, event_id % 4 b1 from events"


@query(
    "events",
    f"with t as ({_BODY}), c as (select *, (b0 >> 4) & 7 frame, b0 & 15 low, b0 >> 4 sound, kind = 9 and b0 >= 128 ev, kind = 8 and b0 >> 4 = 9 ea from t where not (kind = 9 and b0 >= 128 and b0 & 15 = 7) and not (kind = 8 and b0 >> 4 = 9 and b0 & 15 = 7)), "
    "p as (select *, case when ev and low = 6 or ea and low = 5 then b1 when ev or ea then low end packet from c) "
    "select event_id, kind = 9 and frame = 1 keyframe, coalesce(kind = 9 and frame = 1 and case when ev then packet in (1, 3) when low in (7, 12) then b1 = 1 else low in (2, 3, 4, 5) end, false) keyframe_media, "
    "coalesce(kind = 9 and frame <> 5 and (ev and packet = 0 or not ev and low in (7, 12) and b1 = 0) or kind = 8 and (ea and packet = 0 or sound = 10 and b1 = 0), false) sequence_header, "
    "coalesce(kind = 9 and frame <> 5 and (ev and packet = 2 or not ev and low in (7, 12) and b1 = 2) or ea and packet = 2, false) end_of_sequence, ev or ea enhanced from p",
)
def tag_classes(events: DataFrame) -> DataFrame:
    """Events as the heads of media tags: two bytes and a codec's code."""
    k = F.get_json_object("props", "$.k").cast("long")
    first, second = (k * 37 + F.col("event_id")) % 256, F.col("event_id") % 4
    byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    kind = F.when(F.col("event_type").isin("view", "purchase"), 9).when(F.col("event_type") == "click", 8).otherwise(18)
    tags = events.select("event_id", kind.alias("kind"), first.alias("b0"), F.concat(byte(first), byte(second), F.lit("avc1avc1").cast("binary")).alias("body"))
    modex = ((F.col("kind") == 9) & (F.col("b0") >= 128) | (F.col("kind") == 8) & (F.shiftright("b0", 4) == 9)) & (F.col("b0") % 16 == 7)
    return tags.filter(~modex).select("event_id", B.tag_class(F.col("kind"), F.col("body")).alias("c")).select("event_id", *[f"c.{n}" for n in ("keyframe", "keyframe_media", "sequence_header", "end_of_sequence", "enhanced")])


@query("documents", None)
def text_crc32_mpeg2(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", B.crc32_mpeg2(F.col("text").cast("binary")).alias("crc"))


@query(
    "events",
    "with e as (select user_id, event_id, cast(props->>'$.k' as bigint) k, case when event_type = 'signup' then cast(props->>'$.k' as bigint) % 4 end init, case when event_type in ('view', 'purchase') then 'ts' when event_type = 'click' then 'mp4' end kind from events), "
    "w as (select *, last_value(kind ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) wk, last_value(init ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) wi, row_number() over (partition by user_id order by event_id) o from e), "
    "r as (select *, case when kind <> wk then 'kind' when init <> wi then 'init' when k % 20 = 0 and o > 1 then 'break' end reason from w) "
    "select user_id, event_id, cast(count(reason) over (partition by user_id order by event_id) as bigint) part, reason from r",
)
def segment_splits(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type").isin("view", "purchase"), "ts").when(F.col("event_type") == "click", "mp4")
    items = events.select("user_id", "event_id", F.when(F.col("event_type") == "signup", k % 4).alias("init"), kind.alias("kind"), (k % 20 == 0).alias("gap"))
    return repair.segment_splits(items, "user_id", "event_id", "init", "kind", F.col("gap"))


@query(
    "events",
    "with recursive e as (select user_id, event_id, event_type = 'view' f, cast(props->>'$.k' as bigint) s, row_number() over (partition by user_id order by event_id) i from events), "
    "w as (select user_id, event_id, i, case when s >= case when f then 400 else 800 end then 0 else s end held, case when s >= case when f then 400 else 800 end then 1 else 0 end part from e where i = 1 "
    "union all select e.user_id, e.event_id, e.i, case when w.held + e.s >= case when e.f then 400 else 800 end then 0 else w.held + e.s end, w.part + case when w.held + e.s >= case when e.f then 400 else 800 end then 1 else 0 end from w join e on e.user_id = w.user_id and e.i = w.i + 1) "
    "select user_id, event_id, cast(part as bigint) part from w",
)
def media_parts(events: DataFrame) -> DataFrame:
    """Parts of 400 bytes that begin at views, of 800 at any item."""
    items = events.select("user_id", "event_id", chat.micros(F.col("ts")).alias("us"), F.get_json_object("props", "$.k").cast("long").alias("size"), (F.col("event_type") == "view").alias("frame"), F.lit(False).alias("head"), F.lit(False).alias("begins"))
    return repair.limited_media(items, "user_id", "event_id", "us", "size", "frame", "head", "begins", 400).drop("reason")


@query("events", None)
def keyframe_indexes(events: DataFrame) -> DataFrame:
    """The index of each segment's views in the row of its first error, at least two hours apart."""
    items = events.select("user_id", "event_id", "event_type", chat.micros(F.col("ts")).alias("us"), (F.col("event_id") * 100).alias("place"))
    is_ = lambda t: F.col("event_type") == t
    found = repair.keyframe_index(items, "user_id", "event_id", "us", is_("signup"), is_("error"), is_("view"), 7_200_000_000)
    return found.select("user_id", "event_id", F.array_join(F.col("times").cast("array<string>"), ",").alias("times"), F.array_join(F.col("places").cast("array<string>"), ",").alias("places"))


