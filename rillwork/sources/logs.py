"""Log files named after their days, read newest day first, page by page.

A file ``<name>.<yyyy-mm-dd>`` is of that day, another file whose name begins
with the name of the day it was written.  Files outside the asked days, or with
another name than the asked one, aren't opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def log_files(spark: SparkSession, folder: str, name: str, first: str | None = None, last: str | None = None, file: str | None = None) -> DataFrame:
    """(file, day, size, path) of the log files of the days asked for, both included; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{name}*").load(folder).select("path", "modificationTime", "length")
    named = found.withColumn("file", F.regexp_extract(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "[^/]*$", 0))
    suffix = F.when(F.col("file").startswith(f"{name}."), F.substring("file", len(name) + 2, 1000))
    day = F.coalesce(F.when(suffix.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(suffix)), F.to_date("modificationTime"))
    rows = named.select("file", day.alias("day"), F.col("length").alias("size"), "path")
    for value, holds in ((first, lambda v: F.col("day") >= v), (last, lambda v: F.col("day") <= v)):
        if value is not None:
            rows = rows.filter(holds(F.lit(value).cast("date")))
    return rows if file is None else rows.filter(F.col("file") == file)


def write_logs(lines: DataFrame, folder: str, name: str, day: str, order: str) -> None:
    """Writes each day's ``text`` in order to a file ``<name>.<day>``; a day's lines go through one task, and the driver names its file."""
    spark = lines.sparkSession
    lines.select(day, order, "text").repartition(day).sortWithinPartitions(day, order).select(day, "text").write.partitionBy(day).text(f"{folder}/parts")
    written = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{folder}/parts").select("path").collect()
    jvm = spark.sparkContext._jvm
    for path in sorted(r["path"] for r in written):
        source = jvm.org.apache.hadoop.fs.Path(path)
        named = path.rsplit("/", 2)[1].partition("=")[2]
        source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(source, jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.{named}"))


def log_lines(files: DataFrame) -> DataFrame:
    """(day, file, line_no, text) of all lines, numbered from 1 in each file.

    A file may be read in several blocks: lines are numbered inside each, and the blocks before it are counted.  The
    list of files, one or a few for each day, goes through the driver.
    """
    spark = files.sparkSession
    paths = {r["path"]: (r["file"], r["day"]) for r in files.collect()}
    if not paths:
        return spark.createDataFrame([], "day date, file string, line_no long, text string")
    block = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")]
    lines = spark.read.text(list(paths)).select(F.col("value").alias("text"), *block)
    # a block is read by one task in order, so ids rise by one
    blocks = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select("path", "block", (before - F.col("first") + 1).alias("shift"))
    names = spark.createDataFrame([(p, f, d) for p, (f, d) in paths.items()], "path string, file string, day date")
    # files are few, and so are their blocks next to their lines
    return lines.join(placed, ["path", "block"]).join(F.broadcast(names), "path").select("day", "file", (F.col("id") + F.col("shift")).cast("long").alias("line_no"), F.regexp_replace("text", "\r$", "").alias("text"))


def log_page(lines: DataFrame, offset: int = 0, limit: int = 100, contains: str | None = None) -> DataFrame:
    """(day, file, line_no, text, has_more): a page of the lines, newest day first, then by file and line.

    One line more than the page is looked for, so that ``has_more`` says whether there is another page.
    """
    kept = lines if contains is None else lines.filter(F.col("text").contains(contains))
    order = [F.desc("day"), F.col("file"), F.col("line_no")]
    some = kept.orderBy(*order).offset(offset).limit(limit + 1)
    every = Window.orderBy(*order)
    numbered = some.withColumn("place", F.row_number().over(every)).withColumn("n", F.count("*").over(Window.partitionBy()))
    return numbered.filter(F.col("place") <= limit).select("day", "file", "line_no", "text", (F.col("n") > limit).alias("has_more"))
