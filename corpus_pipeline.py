"""The corpus pipeline: stages over documents, each written and read again.

The stages that filter keep every clean document; mixing repeats or leaves out
documents so that sources meet their targets; sharding adds ``shard`` and
``slot``.  SQL can express neither compression lengths nor greedy tiling, so
there is no oracle.  tests/llm/test_pipeline.py judges each stage on what the one
before kept; near_duplicates is compared with brute force in test_jaccard_join.py.

Defined cases: a null or empty text is neither toxic nor contaminated and links
with nothing, so it stays; a null id is kept apart from all others; repeated
rows of one id and text are one document to near_duplicates; columns beyond
those of documents go through all stages; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillwork.llm.decontamination import without_benchmark
from rillwork.llm.jaccard_join import without_near_duplicates
from rillwork.llm.mixing import mixed_documents
from rillwork.llm.scratch import Scratch
from rillwork.llm.sharding import shard_documents
from rillwork.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.put(name, stage(spark, docs, sf_dir))
    return docs
