"""Chat recordings as XML: the lines of messages, gifts and super chats, one file for each segment, and their reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions import scalars as S

# Fixed values of the format: the place of each kind of message on the screen, the size and color of text, the pool.
PLACES = {"chat": 1, "gift": 1, "super_chat": 5, "system": 4, "user_join": 1, "follow": 1, "subscription": 5, "other": 1}
SIZE, COLOR, POOL = 25, 16_777_215, 0
HEAD, FOOT = '<?xml version="1.0" encoding="UTF-8"?>\n<i>', "</i>"


def _seconds(ms: Column) -> Column:
    return F.concat(F.call_function("div", ms, F.lit(1000)).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def _escaped(text: Column) -> Column:
    return S.xml_escaped(F.coalesce(text, F.lit("")))


def _count(meta: Column, *names: str) -> Column:
    """The first of the names that metadata has, if that is a whole number from 0 on; else 0."""
    value = F.coalesce(*[F.get_json_object(meta, f"$.{n}") for n in names])
    return F.when(value.rlike(r"^\d{1,18}$"), value.cast("long")).otherwise(0)


def xml_line(offset_ms: Column, kind: Column, at_ms: Column, user_id: Column, user: Column, content: Column, color: Column, meta: Column, row: Column) -> Column:
    """The line of a message in its segment's file.

    ``offset_ms`` counts from the segment's start and is never below 0; ``meta`` is JSON with gift_name, gift_count,
    price, keep_time or time.  Nulls are empty texts, a color that isn't six hex digits is white, another kind is other.
    """
    ms = F.greatest(offset_ms, F.lit(0))
    place = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in PLACES.items()], F.lit(PLACES["other"]))
    hexed = F.regexp_extract(F.trim(F.coalesce(color, F.lit(""))), "^#?([0-9A-Fa-f]{6})$", 1)
    rgb = F.when(hexed != "", F.conv(hexed, 16, 10).cast("long")).otherwise(COLOR)
    crc = F.crc32(F.coalesce(user_id, F.lit("")).cast("binary"))
    fields = F.concat_ws(",", _seconds(ms), place.cast("string"), F.lit(str(SIZE)), rgb.cast("string"), at_ms.cast("string"), F.lit(str(POOL)), crc.cast("string"), row.cast("string"))
    chat = F.concat(F.lit('  <d p="'), fields, F.lit('" user="'), _escaped(user), F.lit('">'), _escaped(content), F.lit("</d>"))
    attributes = lambda pairs: F.concat(*[x for name, value in pairs for x in (F.lit(f' {name}="'), value, F.lit('"'))])
    who = [("user", _escaped(user)), ("uid", _escaped(user_id))]
    gift = F.concat(F.lit("  <gift"), attributes([("ts", _seconds(ms)), ("giftname", _escaped(F.get_json_object(meta, "$.gift_name"))), ("giftcount", _count(meta, "gift_count").cast("string")), ("price", _count(meta, "price").cast("string")), *who, ("timestamp", at_ms.cast("string"))]), F.lit("></gift>"))
    sc = F.concat(F.lit("  <sc"), attributes([("ts", _seconds(ms)), *who, ("price", _count(meta, "price").cast("string")), ("time", _count(meta, "keep_time", "time").cast("string")), ("timestamp", at_ms.cast("string"))]), F.lit(">"), _escaped(F.trim(content)), F.lit("</sc>"))
    return F.when(kind == "gift", gift).when(kind == "super_chat", sc).otherwise(chat)


def write_recordings(lines: DataFrame, folder: str) -> None:
    """Writes (segment, order, line) as one XML file for each segment, below ``segment=<segment>``; a segment's lines go through one task.

    The head and the foot go with a segment's first and last line, through the same window: as rows of their own, in a union,
    they would need a shuffle that Spark leaves out where it takes the union for partitioned by segment already.
    """
    line = Window.partitionBy("segment").orderBy("order")
    head = F.when(F.row_number().over(line) == 1, F.lit(HEAD))
    foot = F.when(F.lead(F.lit(True)).over(line).isNull(), F.lit(FOOT))
    framed = lines.select("segment", "order", F.concat_ws("\n", head, F.coalesce("line", F.lit("")), foot).alias("line"))
    framed.sortWithinPartitions("segment", "order").select("segment", "line").write.partitionBy("segment").option("maxRecordsPerFile", 0).text(folder)


def read_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """(file, kind, time, mode, timestamp_ms, user_hash, row_id, username, content) of the messages in XML files.

    A message needs eight fields with a time and a mode, a gift or a super chat its time; others are left out.
    Timestamps below 10^11 are seconds.  Older files have the name behind the row's id.  Gifts and super chats, which
    have no ids, are numbered by time in each file.
    """
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("ignoreSurroundingSpaces", "false").schema(schema).load(folder).withColumn("file", F.col("_metadata.file_path"))
    number = lambda c: c.try_cast("double")
    stamp = lambda c: F.when(F.abs(number(c)) < 1e11, number(c) * 1000).otherwise(number(c)).cast("long")
    parts = F.split(F.col("_p"), ",")
    at = lambda k: F.get(parts, F.lit(k))
    said = read("d", "_p string, _user string, _VALUE string").filter((F.size(parts) >= 8) & number(at(0)).isNotNull() & number(at(1)).isNotNull())
    legacy = lambda k: F.regexp_extract(at(7), r"^(.*?)\s+user=(.*)$", k)
    has_name = at(7).rlike(r"\s+user=")
    chats = said.select(
        "file", F.lit("chat").alias("kind"), number(at(0)).alias("time"), number(at(1)).cast("int").alias("mode"), stamp(at(4)).alias("timestamp_ms"), at(6).alias("user_hash"),
        F.when(has_name, legacy(1)).otherwise(at(7)).alias("row_id"), F.coalesce(F.when(F.col("_user") != "", F.col("_user")), F.when(has_name, legacy(2))).alias("username"), F.coalesce("_VALUE", F.lit("")).alias("content"),
    )
    named = F.coalesce(F.when(F.col("_giftname") != "", F.col("_giftname")), F.lit("Gift"))
    gift = F.when(F.col("_giftcount") != "", F.concat(named, F.lit(" x"), F.col("_giftcount"))).otherwise(named)
    gifts = read("gift", "_ts string, _giftname string, _giftcount string, _user string, _uid string, _timestamp string, _VALUE string").withColumn("content", gift)
    paid = read("sc", "_ts string, _user string, _uid string, _timestamp string, _VALUE string").withColumn("content", F.coalesce("_VALUE", F.lit("")))
    out = chats
    for rows, kind, tag, mode in ((gifts, "gift", "gift", 1), (paid, "super_chat", "sc", 5)):
        line = Window.partitionBy("file").orderBy(number(F.col("_ts")), "_timestamp", "_user", "content")
        found = rows.filter(number(F.col("_ts")).isNotNull())
        out = out.unionByName(found.select("file", F.lit(kind).alias("kind"), number(F.col("_ts")).alias("time"), F.lit(mode).alias("mode"), stamp(F.col("_timestamp")).alias("timestamp_ms"), F.coalesce("_uid", F.lit("")).alias("user_hash"), F.concat(F.lit(f"{tag}-"), F.row_number().over(line).cast("string")).alias("row_id"), F.when(F.col("_user") != "", F.col("_user")).alias("username"), "content"))
    return out
