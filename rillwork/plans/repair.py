"""Order-dependent repair: events as the items of streams, one stream for each user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.operators import chat, repair

from .registry import query

KEYS = ("user_id", "event_id")
HEADER, SCRIPT, VIDEO, MEDIA = ("signup",), ("error",), ("view", "purchase"), ("view", "click", "purchase")
_SEG = "(select *, cast(count(*) filter (event_type = 'signup') over (partition by user_id order by event_id) as bigint) segment, epoch_us(ts) us from events)"


def _is(kinds: tuple[str, ...]) -> Column:
    return F.col("event_type").isin(*kinds)


def _items(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", "event_type", "value", chat.micros(F.col("ts")).alias("us"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("events", f"select event_id, segment from (select *, count(*) over (partition by user_id, segment) n from {_SEG}) where segment = 0 or n >= 4")
def defragment(events: DataFrame) -> DataFrame:
    return repair.defragment(_items(events), *KEYS, _is(HEADER), 4).select("event_id", "segment")


@query("events", "select user_id, event_id - 1 as event_id from (select user_id, min(event_id) event_id, arg_min(event_type, event_id) t from events group by 1) where t <> 'signup'")
def header_check(events: DataFrame) -> DataFrame:
    return repair.missing_headers(_items(events), *KEYS, _is(HEADER))


@query("events", f"select event_id from (select *, row_number() over (partition by user_id, segment, event_type order by event_id) n from {_SEG}) where event_type <> 'error' or n = 1")
def script_filter(events: DataFrame) -> DataFrame:
    return repair.first_of_segment(_items(events), *KEYS, _is(HEADER), _is(SCRIPT)).select("event_id")


@query("events", f"select event_id from (select *, row_number() over (partition by user_id, segment, event_type, cast(props->>'$.k' as bigint) % 4 order by event_id) n from {_SEG}) where event_type in ('signup', 'error') or n = 1")
def dup_exact(events: DataFrame) -> DataFrame:
    return repair.without_duplicates(_items(events).withColumn("crc", F.col("k") % 4), *KEYS, _is(HEADER), _is(MEDIA), ["event_type", "crc"]).select("event_id")


@query(
    "events",
    "with g as (select *, epoch_us(ts) us, count(*) filter (event_type = 'purchase') over (partition by user_id order by event_id) gop from events) "
    "select event_id, row_number() over (partition by user_id order by gop, case when event_type = 'error' then 0 else 1 end, case when event_type = 'error' then 0 else us // 3600000000 end, case when event_type in ('view', 'purchase') then 0 else 1 end, event_id) place from g",
)
def gop_sort(events: DataFrame) -> DataFrame:
    items = _items(events).withColumn("hour", F.expr("us div 3600000000"))
    return repair.gop_order(items, *KEYS, "hour", F.col("event_type") == "purchase", _is(SCRIPT), _is(VIDEO)).select("event_id", "place")


@query("events", f"select event_id, cast(case when event_type = 'signup' then 0 else us - first_value(case when event_type <> 'signup' then us end ignore nulls) over (partition by user_id, segment order by event_id rows between unbounded preceding and unbounded following) end as bigint) as local from {_SEG}")
def time_reset(events: DataFrame) -> DataFrame:
    return repair.time_from_segment_start(_items(events), *KEYS, "us", _is(HEADER)).select("event_id", "local")


@query(
    "events",
    f"with s as (select * from {_SEG}), e as (select user_id, segment, arg_min(us, event_id) f, arg_max(us, event_id) l from s where event_type <> 'signup' group by 1, 2), "
    "j as (select *, coalesce(lag(l) over (partition by user_id order by segment) - f, -f) d from e), h as (select user_id, segment, sum(d) over (partition by user_id order by segment) shift from j) "
    "select event_id, cast(case when event_type = 'signup' then 0 else us + shift end as bigint) as local from s left join h using (user_id, segment)",
)
def time_continuous(events: DataFrame) -> DataFrame:
    return repair.time_continued(_items(events), *KEYS, "us", _is(HEADER)).select("event_id", "local")


@query(
    "events",
    "with c as (select *, last_value(case when event_type = 'signup' then cast(props->>'$.k' as bigint) % 3 end ignore nulls) over (partition by user_id order by event_id) now from events), "
    "w as (select *, last_value(case when event_type <> 'signup' then now end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) was from c) "
    "select event_id, cast(sum(case when event_type <> 'signup' and now <> was then 1 else 0 end) over (partition by user_id order by event_id) as bigint) part from w",
)
def split_on_change(events: DataFrame) -> DataFrame:
    return repair.split_on_change(_items(events).withColumn("signature", F.col("k") % 3), *KEYS, _is(HEADER), "signature").select("event_id", "part")


@query("events", "select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id) header from events")
def carry_last(events: DataFrame) -> DataFrame:
    return events.select("event_id", repair.carried(*KEYS, F.when(_is(HEADER), F.col("event_id"))).alias("header"))


@query("lineitem", "with r as (select l_orderkey k, l_partkey a, l_partkey + cast(l_quantity as bigint) b from lineitem), m as (select *, max(b) over (partition by k order by a, b rows between unbounded preceding and 1 preceding) reach from r), i as (select *, sum(case when a > reach + 1 or reach is null then 1 else 0 end) over (partition by k order by a, b) g from m) select k, min(a) a, max(b) b from i group by k, g")
def dead_range_coalesce(lineitem: DataFrame) -> DataFrame:
    ranges = lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("b"))
    return repair.merged_ranges(ranges, "k", "a", "b")


@query("events", "with r as (select event_type, event_id, cast(props->>'$.k' as bigint) k, event_id - row_number() over (partition by event_type order by event_id) g from events) select event_type, event_id, cast(sum(k) over (partition by event_type, g order by event_id) - k as bigint) as \"offset\" from r")
def byte_ranges(events: DataFrame) -> DataFrame:
    return repair.byte_offsets(_items(events), "event_type", "event_id", "k").select("event_type", "event_id", "offset")


@query("events", "with t as (select event_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by event_id) g from events) select event_id, greatest(g, 0) gap, greatest(g, 0) > 3600000000 as pause from t where g is not null")
def timeline_gap_class(events: DataFrame) -> DataFrame:
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("event_id"))
    return _items(events).select("event_id", gap.alias("gap")).filter("gap is not null").select("event_id", F.greatest("gap", F.lit(0)).cast("long").alias("gap"), (F.greatest("gap", F.lit(0)) > 3_600_000_000).alias("pause"))


@query("events", "with w as (select user_id, event_id, event_id as first, event_id + cast(props->>'$.k' as bigint) last, lag(event_id + cast(props->>'$.k' as bigint)) over (partition by user_id order by event_id) before from events) select user_id, event_id, before + 1 missing_from, first - 1 missing_to from w where first > before + 1")
def window_slide_missing(events: DataFrame) -> DataFrame:
    before = F.lag(F.col("event_id") + F.col("k")).over(Window.partitionBy("user_id").orderBy("event_id"))
    found = _items(events).select("user_id", "event_id", before.alias("before")).filter("event_id > before + 1")
    return found.select("user_id", "event_id", (F.col("before") + 1).alias("missing_from"), (F.col("event_id") - 1).alias("missing_to"))


@query("events", "select user_id, count(*) filter (event_type in ('view', 'purchase')) video, count(*) filter (event_type = 'click') audio, cast(sum(cast(props->>'$.k' as bigint) + 15) as bigint) size, (max(epoch_us(ts)) - min(epoch_us(ts))) // 1000000 duration_s, arg_min(epoch_us(ts), event_id) filter (event_type = 'click') first_audio from events group by 1")
def flv_stats(events: DataFrame) -> DataFrame:
    return _items(events).groupBy("user_id").agg(F.count_if(_is(VIDEO)).alias("video"), F.count_if(F.col("event_type") == "click").alias("audio"), F.sum(F.col("k") + 15).alias("size"), F.expr("(max(us) - min(us)) div 1000000").alias("duration_s"), F.min_by("us", F.when(F.col("event_type") == "click", F.col("event_id"))).alias("first_audio"))


@query("lineitem", "select l_returnflag, count(*) segments, cast(sum(cast(l_quantity as bigint)) as bigint) size, max(cast(l_quantity as bigint)) longest, cast(sum(cast(l_quantity as bigint)) * 8 // count(*) as bigint) rate from lineitem group by 1")
def hls_stats(lineitem: DataFrame) -> DataFrame:
    size = F.col("l_quantity").cast("long")
    return lineitem.groupBy("l_returnflag").agg(F.count("*").alias("segments"), F.sum(size).alias("size"), F.max(size).alias("longest"), F.expr("sum(cast(l_quantity as bigint)) * 8 div count(*)").alias("rate"))


@query("events", "with d as (select user_id, event_id, epoch_us(ts) us, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by event_id) d from events) select user_id, event_id, cast(sum(case when d is null then us when d < 0 or d > 600000000 then 40000 else d end) over (partition by user_id order by event_id) as bigint) result from d")
def timing_repair_relaxed(events: DataFrame) -> DataFrame:
    return repair.timing_repaired(_items(events), *KEYS, "us", 600_000_000, 40_000)


@query("events", None)
def segment_limit_hls(events: DataFrame) -> DataFrame:
    return repair.limited_segments(_items(events), *KEYS, "k", 400)


@query("events", None)
def keyframe_thin(events: DataFrame) -> DataFrame:
    return repair.thinned(_items(events), *KEYS, "us", 7_200_000_000)
