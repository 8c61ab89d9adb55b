"""State machines over events: as streams with timers and over tables; users are keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.operators import chat, machines
from rillwork.operators.machines import walked
from rillwork.streaming import machine_stream, run_to_end, stream_of

from .registry import joined, query

HOUR = 3_600_000_000
#: Rows of a stream may come so late; what is due this long before the last row is the table form's end.
DELAY = 24 * HOUR
IDLE = 48 * HOUR
_UNTIL = f"(select max(epoch_us(ts)) // 1000 * 1000 - {DELAY} from events)"


def _rows(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    return events.select("event_id", "user_id", chat.micros(F.col("ts")).alias("us"), kind.alias("type"), k.alias("k"), kind.isin("error", "purchase").alias("ends"), (kind == "purchase").alias("definite"))


def _until(rows: DataFrame) -> DataFrame:
    """The time up to which a stream of the rows is decided at its end."""
    return rows.crossJoin(F.broadcast(rows.agg((F.expr("max(us) div 1000") * 1000 - DELAY).alias("until"))))


_SESSIONS = machines.Sessions("us", "ends", "definite", HOUR)
_SESSION_SQL = f"""
with e as (select user_id, event_id, epoch_us(ts) us, event_type in ('error', 'purchase') d, event_type = 'purchase' p from events where epoch_us(ts) <= {_UNTIL}),
     g as (select *, count(*) filter (not d) over (partition by user_id order by us, event_id) l, row_number() over (partition by user_id order by us, event_id) o from e),
     s as (select user_id, l, min(us) filter (not d) live, min(us) filter (d) t1, min(us) filter (p) td, arg_min(p, o) filter (d) sure from g where l > 0 group by 1, 2),
     n as (select *, lead(live) over (partition by user_id order by l) follow from s),
     c as (select *, case when td <= t1 + {HOUR} then td when t1 + {HOUR} < coalesce(follow, {_UNTIL} + 1) then t1 + {HOUR} when td is not null then t1 + {HOUR} end ended, not (sure and td = t1) via from n),
     k as (select *, coalesce(sum((ended is not null)::int) over (partition by user_id order by l rows between unbounded preceding and 1 preceding), 0) number from c),
     f as (select *, min(live) over (partition by user_id, number) started_us, row_number() over (partition by user_id, number order by l) place, lag(t1) over (partition by user_id, number order by l) waits from k)
select user_id, started_us, 'started' what, live at_us, false via_hysteresis from f where place = 1
union all select user_id, started_us, 'resumed', live, true from f where waits is not null
union all select user_id, started_us, 'ending', t1, false from f where t1 is not null and not sure
union all select user_id, started_us, 'ended', ended, via from f where ended is not null"""


@query("events", _SESSION_SQL)
def live_sessions(events: DataFrame) -> DataFrame:
    return walked(_until(_rows(events)), "user_id", ["us", "event_id"], _SESSIONS, "us", "until")


@joined(_SESSION_SQL)
def stream_live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(stream_of(spark, f"{sf_dir}/events.parquet"))
    return run_to_end(machine_stream(rows, "user_id", "us", ["event_id"], _SESSIONS, "24 hours"), "append")


_PAIRING = machines.Pairing("us", "kind", "ix", "path", IDLE)
_PAIR_SQL = f"""
with e as (select user_id, event_id, epoch_us(ts) us, case event_type when 'view' then 'video' when 'click' then 'chat' when 'error' then 'chat_stopped' when 'purchase' then 'ended' else 'persisted' end kind, cast(props->>'$.k' as bigint) % 3 ix
           from events where epoch_us(ts) <= {_UNTIL}),
     g as (select *, us - lag(us) over (partition by user_id order by us, event_id) gap, row_number() over (partition by user_id order by us, event_id) o from e),
     i as (select *, sum((coalesce(gap, 0) > {IDLE})::int) over (partition by user_id order by o) isle from g),
     f as (select user_id, isle, ix, min(o) filter (kind = 'video') v, min(o) filter (kind = 'chat') c from i where kind in ('video', 'chat') group by 1, 2, 3),
     w as (select user_id, isle, min(o) filter (kind = 'ended') e1, min(o) filter (kind = 'persisted') p1, min(o) filter (kind = 'video') v1, min(o) filter (kind = 'chat') c1, min(o) filter (kind = 'chat_stopped') s1, max(o) last, max(us) last_us from i group by 1, 2),
     d as (select *, case when e1 is null or p1 is null or v1 is null then null when c1 is null or c1 > greatest(e1, p1, v1) then greatest(e1, p1, v1) when s1 is not null then greatest(e1, p1, v1, s1) end done, lead(isle) over (partition by user_id order by isle) follow from w),
     x as (select user_id, isle, ix "index", 'pair' what, greatest(v, c) upto, ix only_ix, '' unmet from f where v is not null and c is not null
           union all select user_id, isle, null, 'complete', done, null, '' from d where done is not null
           union all select user_id, isle, null, 'evicted', last, null, array_to_string(list_filter([case when e1 is null then 'ended' end, case when p1 is null then 'persisted' end, case when c1 is not null and s1 is null then 'chat_stopped' end, case when v1 is null then 'video' end], lambda y: y is not null), ',')
                     from d where done is null and (follow is not null or last_us + {IDLE} <= {_UNTIL}))
select x.user_id, what, "index", unmet,
       coalesce(string_agg(cast(event_id as varchar), ',' order by ix, o) filter (kind = 'video'), '') videos, coalesce(string_agg(cast(event_id as varchar), ',' order by ix, o) filter (kind = 'chat'), '') chats
from x join i on i.user_id = x.user_id and i.isle = x.isle and i.o <= x.upto and (x.only_ix is null or x.only_ix = i.ix) group by x.user_id, x.isle, what, "index", unmet"""


def _artifacts(events: DataFrame) -> DataFrame:
    kind = F.expr("case type when 'view' then 'video' when 'click' then 'chat' when 'error' then 'chat_stopped' when 'purchase' then 'ended' else 'persisted' end")
    artifact = F.col("type").isin("view", "click")
    return _rows(events).select("event_id", "user_id", "us", kind.alias("kind"), F.when(artifact, F.col("k") % 3).alias("ix"), F.when(artifact, F.col("event_id").cast("string")).alias("path"))


def _joined_lists(found: DataFrame) -> DataFrame:
    return found.select("user_id", "what", "index", *[F.array_join(c, ",").alias(c) for c in ("unmet", "videos", "chats")])


@query("events", _PAIR_SQL)
def session_pairs(events: DataFrame) -> DataFrame:
    return _joined_lists(walked(_until(_artifacts(events)), "user_id", ["us", "event_id"], _PAIRING, "us", "until"))


@joined(_PAIR_SQL)
def stream_session_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _artifacts(stream_of(spark, f"{sf_dir}/events.parquet"))
    return _joined_lists(run_to_end(machine_stream(rows, "user_id", "us", ["event_id"], _PAIRING, "24 hours"), "append"))


@query("events", None)
def assembled_segments(events: DataFrame) -> DataFrame:
    """Each user's events as segments that arrive out of order: views and clicks are media, two of them of an init."""
    rows = _rows(events)
    kind = F.expr("case type when 'signup' then 'init' when 'error' then 'dead' when 'purchase' then 'media' else 'media' end")
    place = F.expr("row_number() over (partition by user_id order by event_id)").cast("long")
    segments = rows.select("user_id", "event_id", "us", kind.alias("kind"), (place + F.col("k") % 4).alias("number"), F.lit(None).cast("long").alias("to"), F.col("k").alias("size"), F.when(F.col("type").isin("signup", "purchase"), F.lit("a")).alias("init"))
    return walked(segments, "user_id", ["event_id"], machines.Assembler("us", "kind", "number", "to", "size", "init", skip_count=3, skip_us=6 * HOUR, most=12), "us")


_PLAN_SQL = """
with s as (select user_id, event_id snapshot, 2 * row_number() over (partition by user_id order by event_id) + cast(props->>'$.k' as bigint) % 9 as first, cast(props->>'$.k' as bigint) k from events),
     m as (select *, max(first + 6) over (partition by user_id order by snapshot rows between unbounded preceding and 1 preceding) mark from s),
     n as (select user_id, snapshot, unnest(range(greatest(first, coalesce(mark, first)), first + 6)) as number, k from m where mark is null or first + 6 >= mark),
     u as (select *, case when (number * 7 + k) % 4 <> 0 then 'plan' else 'skipped' end what from n),
     g as (select *, number - row_number() over (partition by user_id, snapshot, what order by number) g from u)
select user_id, snapshot, what, min(number) as "number", max(number) as "to" from g group by user_id, snapshot, what, g
union all select user_id, snapshot, 'missing', mark, first - 1 from m where first > mark
union all select user_id, snapshot, 'stale', first, first + 5 from m where first + 6 < mark"""


@query("events", _PLAN_SQL)
def planned_numbers(events: DataFrame) -> DataFrame:
    """Each user's events as snapshots of a window of six numbers that slides by two, and jumps."""
    place = F.expr("row_number() over (partition by user_id order by event_id)").cast("long")
    rows = _rows(events).select("user_id", F.col("event_id").alias("snapshot"), (2 * place + F.col("k") % 9).alias("first"), "k")
    usable = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: ((F.col("first") + i) * 7 + F.col("k")) % 4 != 0)
    return walked(rows.withColumn("usable", usable), "user_id", ["snapshot"], machines.Planner("snapshot", "first", "usable"))


@query("events", None)
def replays_dropped(events: DataFrame) -> DataFrame:
    """Each user's events as media items; a user's last fifth comes again, shifted by some hours."""
    rows = _rows(events).select("user_id", "event_id", F.expr("us div 1000").alias("ms"), F.concat_ws(":", "type", "k").alias("identity"), (F.col("type") == "signup").alias("header"))
    last = F.expr("ntile(5) over (partition by user_id order by event_id)") == 5
    again = rows.filter("not header").withColumn("last", last).filter("last").drop("last").select("user_id", (F.col("event_id") + 1_000_000_000).alias("event_id"), (F.col("ms") - 7_200_000).alias("ms"), "identity", "header")
    items = rows.unionByName(again).withColumn("media", ~F.col("header")).withColumn("begins", F.lit(False))
    return walked(items.filter("media"), "user_id", ["event_id"], machines.Replay("event_id", "begins", "media", "ms", "identity"))
