"""Tables that cut lineage, in the folder that all executors share.

The folder is the one named by ``spark.checkpoint.dir``.  Only a local session
that names none gets a folder of its own; a cluster must name one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With it, Spark frees a query's shuffle files as soon as the query ends, not when the driver collects garbage.
FREED_AT_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"


class Scratch:
    """Parquet tables of one run; ``drop`` frees those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Writes df once and returns a frame that reads it back."""
        path = f"{self.root}/{name}"
        conf = self.spark.conf
        before = conf.get(FREED_AT_END)
        conf.set(FREED_AT_END, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(FREED_AT_END, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
