"""Rolling state: events as the checks of streamers, errors as failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwork.operators import chat, rolling

from .registry import query

MINUTE_US = 60_000_000
_WINDOW = "count(*) over (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row)"


def _checks(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", "event_type", "value", chat.micros(F.col("ts")).alias("us"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("events", f"select event_id, cast(case when n < 3 then 0 else least(1000 * 2 ** least(n - 3, 16), 8000) end as bigint) backoff_ms, n < 10 as restart from (select event_id, {_WINDOW} n from events where event_type = 'error')")
def restart_backoff(events: DataFrame) -> DataFrame:
    recent = F.count("*").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0))
    found = _checks(events).filter("event_type = 'error'").select("event_id", recent.alias("n"))
    return found.select("event_id", rolling.backoff(F.col("n"), 3, 1000, 8000).alias("backoff_ms"), (F.col("n") < 10).alias("restart"))


_STREAK = "with i as (select *, sum(case when event_type in ('error', 'click') then 0 else 1 end) over (partition by user_id order by event_id) g from events), s as (select *, count(*) filter (event_type in ('error', 'click')) over (partition by user_id, g order by event_id) streak from i) "


@query("events", _STREAK + "select event_id, streak from s")
def consecutive_errors(events: DataFrame) -> DataFrame:
    return rolling.consecutive(events.select("event_id", "user_id", "event_type"), "user_id", "event_id", F.col("event_type").isin("error", "click")).select("event_id", "streak")


@query("events", _STREAK + "select event_id, cast(epoch_us(ts) // 1000 + least(60000 * 2 ** least(streak - 3, 16), 3600000) as bigint) disabled_until_ms from s where streak >= 3")
def disabled_until(events: DataFrame) -> DataFrame:
    found = rolling.consecutive(_checks(events), "user_id", "event_id", F.col("event_type").isin("error", "click")).filter("streak >= 3")
    return found.select("event_id", (F.expr("us div 1000") + rolling.backoff(F.col("streak"), 3, 60_000, 3_600_000)).alias("disabled_until_ms"))


@query("events", "select event_id, coalesce(last_value(case when cast(props->>'$.k' as bigint) > 80 then true when cast(props->>'$.k' as bigint) < 30 then false end ignore nulls) over (partition by user_id order by event_id), false) throttled from events")
def throttle_state(events: DataFrame) -> DataFrame:
    return _checks(events).select("event_id", rolling.throttled("user_id", "event_id", F.col("k"), 30, 80).alias("throttled"))


@query("events", "select epoch_us(ts) // 60000000 as bucket, bool_or(event_type = 'signup') all_keys, case when bool_or(event_type = 'signup') then '' else string_agg(distinct cast(user_id as varchar), ',' order by cast(user_id as varchar)) end keys from events group by 1")
def coalesce_window(events: DataFrame) -> DataFrame:
    found = rolling.coalesced(_checks(events), "us", MINUTE_US, F.col("user_id").cast("string"), F.col("event_type") == "signup")
    return found.select("bucket", "all_keys", F.array_join("keys", ",").alias("keys"))


@query("events", "select event_id, avg(cast(props->>'$.k' as bigint)) over (partition by user_id order by event_id rows between 9 preceding and current row) recent_mean from events")
def latency_recent_avg(events: DataFrame) -> DataFrame:
    return _checks(events).select("event_id", F.avg("k").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0)).alias("recent_mean"))


@query("events", "select user_id, count(*) n, cast(sum(cast(props->>'$.k' as bigint)) as bigint) total, min(cast(props->>'$.k' as bigint)) low, max(cast(props->>'$.k' as bigint)) high, count(*) filter (event_type = 'error') restarts from events group by 1")
def latency_stats(events: DataFrame) -> DataFrame:
    return _checks(events).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.min("k").alias("low"), F.max("k").alias("high"), F.count_if(F.col("event_type") == "error").alias("restarts"))


@query(
    "events",
    "with e as (select *, epoch_us(ts) us, event_type in ('error', 'purchase') d from events), a as (select *, max(case when not d then us end) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding) alive from e), "
    "s as (select *, case when d then min(case when d then us end) over (partition by user_id, alive order by us, event_id) end since from a), "
    "w as (select *, not d and (coalesce(lag(event_type = 'purchase') over o, false) or coalesce(us - lag(since) over o > 3600000000, false)) starts from s window o as (partition by user_id order by us, event_id)) "
    "select event_id, cast(sum(cast(starts as int)) over (partition by user_id order by us, event_id) as bigint) as session from w",
)
def hysteresis_sessions(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return rolling.hysteresis_sessions(_checks(events), "user_id", "us", "event_id", kind.isin("error", "purchase"), kind == "purchase", 3_600_000_000).select("event_id", "session")


@query("events", None)
def offline_signals(events: DataFrame) -> DataFrame:
    return rolling.offline_signals(_checks(events).withColumn("failed", F.col("event_type") == "error"), "user_id", "us", "event_id", "failed", 172_800_000_000, 2)


@query(
    "events",
    "with r as (select epoch_us(ts) // 10000000 b, count(*) n from events group by 1), p as (select k, count(distinct b // cast(2 ** k as bigint)) points from r, generate_series(0, 40) g(k) group by 1), "
    "w as (select cast(2 ** min(k) as bigint) w from p where points - 1 <= 2160) select b // w * w * 10 bucket_s, cast(sum(n) as bigint) n from r, w group by 1",
)
def chat_rate_coarsened(events: DataFrame) -> DataFrame:
    return rolling.coarsened_rate(chat.messages(events), "us", 10).select("bucket_s", "n")


@query(
    "events",
    "with recursive e as (select event_id, user_id, case when event_type = 'error' then 0 else cast(props->>'$.k' as bigint) end s, row_number() over (partition by user_id order by event_id) i from events), "
    "w as (select event_id, user_id, i, case when coalesce(s, 0) = 0 then 100 else greatest((300 + s) // 4, 1) end estimate from e where i = 1 "
    "union all select e.event_id, e.user_id, e.i, case when coalesce(e.s, 0) = 0 then w.estimate else greatest((3 * w.estimate + e.s) // 4, 1) end from w join e on e.user_id = w.user_id and e.i = w.i + 1) select event_id, cast(estimate as bigint) estimate from w",
)
def size_estimate(events: DataFrame) -> DataFrame:
    sizes = _checks(events).withColumn("size", F.when(F.col("event_type") == "error", 0).otherwise(F.col("k")).cast("long"))
    return rolling.size_estimates(sizes, "user_id", "event_id", "size", 100).select("event_id", "estimate")


@query("events", "select event_id, case when event_type = 'error' and n > 3 then 'terminal' when event_type in ('error', 'click') then 'retry' else 'done' end verdict from (select *, row_number() over (partition by user_id, event_type order by event_id) n from events)")
def retry_class(events: DataFrame) -> DataFrame:
    attempt = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    rows = events.select("event_id", "event_type", attempt.alias("n"))
    kind = F.col("event_type")
    return rows.select("event_id", F.when((kind == "error") & (F.col("n") > 3), "terminal").when(kind.isin("error", "click"), "retry").otherwise("done").alias("verdict"))


@query("events", "with r as (select event_type kind, epoch_us(ts) // 60000000 b, count(*) n from events group by 1, 2) select kind, max(n) peak, cast(sum(n) as double) / count(*) mean from r group by 1")
def peak_per_minute(events: DataFrame) -> DataFrame:
    series = _checks(events).groupBy(F.col("event_type").alias("kind"), F.expr(f"us div {MINUTE_US}").alias("b")).agg(F.count("*").alias("n"))
    return series.groupBy("kind").agg(F.max("n").alias("peak"), (F.sum("n").cast("double") / F.count("*")).alias("mean"))


@query("events", None)
def chat_distinct_hll(events: DataFrame) -> DataFrame:
    """Sketches of 2**12 registers; the estimate differs from the exact count by some percent."""
    return events.groupBy(F.col("event_type").alias("kind")).agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 12)).alias("senders"))


@query("events", "select user_id, arg_max(event_type, event_id) username, count(*) n from events group by 1")
def latest_username(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("username"), F.count("*").alias("n"))
