"""File sources: events as day-named logs and as chat recordings, written, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.operators import chat
from rillwork.shared import shared_folder
from rillwork.sources import logs, recordings

from .registry import joined, query, table


def _messages(events: DataFrame) -> DataFrame:
    """Events as messages of one segment for each day; purchases are gifts, signups super chats."""
    ms = F.call_function("div", chat.micros(F.col("ts")), F.lit(1000))
    kind = F.expr("case event_type when 'purchase' then 'gift' when 'signup' then 'super_chat' when 'error' then 'system' else 'chat' end")
    k = F.get_json_object("props", "$.k")
    meta = F.to_json(F.struct(F.concat(F.lit("<g"), k, F.lit(">")).alias("gift_name"), k.cast("long").alias("gift_count"), (F.col("user_id") % 9).alias("price"), F.lit(60).alias("time")))
    rows = events.select("event_id", ms.alias("ms"), (ms - ms % 86_400_000).alias("start"), kind.alias("kind"), F.col("user_id").cast("string").alias("uid"), F.concat(F.lit("u&"), F.col("user_id").cast("string")).alias("user"), F.col("props").alias("content"), F.concat(F.lit("#0000"), F.lpad(F.hex(F.col("user_id") % 256), 2, "0")).alias("color"), meta.alias("meta"))
    return rows.withColumn("segment", F.expr("start div 86400000")).withColumn("row", F.expr("row_number() over (partition by segment order by event_id)"))


def _lines(events: DataFrame) -> DataFrame:
    c = F.col
    line = recordings.xml_line(c("ms") - c("start"), c("kind"), c("ms"), c("uid"), c("user"), c("content"), c("color"), c("meta"), c("row"))
    return _messages(events).select("segment", F.col("event_id").alias("order"), line.alias("line"))


@query("events", None)
def recording_lines(events: DataFrame) -> DataFrame:
    return _lines(events)


_READ = """
with m as (select event_id, user_id, props, cast(props->>'$.k' as bigint) k, epoch_us(ts) // 1000 ms, epoch_us(ts) // 86400000000 seg, event_type from events),
     r as (select *, row_number() over (partition by seg order by event_id) as row_no, ms - seg * 86400000 as off from m),
     g as (select *, row_number() over (partition by seg, event_type order by off / 1000.0, cast(ms as varchar), 'u&' || user_id, content_) place from (select *, case event_type when 'purchase' then '<g' || k || '>' || ' x' || k else props end content_ from r))
select case event_type when 'purchase' then 'gift' when 'signup' then 'super_chat' else 'chat' end kind, off / 1000.0::double as time, case event_type when 'signup' then 5 when 'error' then 4 else 1 end as mode, ms timestamp_ms,
       case event_type when 'purchase' then 'gift-' || place when 'signup' then 'sc-' || place else cast(row_no as varchar) end row_id, 'u&' || user_id username, content_ as content from g"""


@joined(_READ)
def recordings_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "recordings")
    recordings.write_recordings(_lines(table(spark, sf_dir, "events")), folder)
    return recordings.read_recordings(spark, folder).select("kind", "time", "mode", "timestamp_ms", "row_id", "username", "content")


_LOG = """
with l as (select cast(ts as date) as day_, event_type || ' ' || props as text, row_number() over (partition by cast(ts as date) order by event_id) line_no from events),
     f as (select *, row_number() over (order by day_ desc, line_no) place from l where contains(text, 'error'))
select 'app.log.' || day_ as file, line_no, text, (select count(*) from f) > 130 has_more from f where place > 30 and place <= 130"""


@joined(_LOG)
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines 31 to 130 with errors, newest day first, of logs that have each day's events."""
    folder = shared_folder(spark, "logs")
    lines = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", F.concat_ws(" ", "event_type", "props").alias("text"))
    logs.write_logs(lines, folder, "app.log", "day", "event_id")
    return logs.log_page(logs.log_lines(logs.log_files(spark, folder, "app.log")), 30, 100, "error").select("file", "line_no", "text", "has_more")
