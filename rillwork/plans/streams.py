"""Streaming forms of batch queries, run to the end of the input; they must give the batch form's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.operators import chat
from rillwork.streaming import run_to_end, stream_of

from .registry import joined


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.messages(stream_of(spark, f"{sf_dir}/events.parquet"))


@joined("select epoch_us(ts) // 10000000 * 10 bucket_s, count(*) n from events group by 1")
def stream_rate_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(chat.rate(_messages(spark, sf_dir), 10), "complete")


@joined("select user_id, count(*) n from events group by 1")
def stream_talkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_end(chat.talkers(_messages(spark, sf_dir)), "complete")


@joined("select distinct user_id, event_type kind from events")
def stream_triggers_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (user, kind) fires once, whatever is read again."""
    return run_to_end(_messages(spark, sf_dir).select("user_id", "kind").dropDuplicates(), "append")


@joined("select event_type kind, count(*) n, max(event_id) latest from events where event_type <> 'view' group by 1")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _messages(spark, sf_dir).filter("kind <> 'view'").groupBy("kind").agg(F.count("*").alias("n"), F.max("seq").alias("latest"))
    return run_to_end(counted, "complete")
