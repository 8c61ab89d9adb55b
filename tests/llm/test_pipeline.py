"""The corpus pipeline: each stage judged on what the one before kept."""

import re
from collections import Counter

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F

from rillwork.llm import queries
from rillwork.llm.decontamination import decontaminate
from rillwork.llm.toxicity import classify_toxicity

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    seen = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, SF)
        now = spark.createDataFrame(now.collect(), now.schema)
        seen[name] = (before, now)
        if name != "sharding":
            assert now.columns == docs.columns
    ids = lambda d: Counter(r["doc_id"] for r in d.select("doc_id").collect())
    toxic = {r["doc_id"] for r in classify_toxicity(docs, labels).filter("predicted = 1").collect()}
    assert ids(seen["toxicity"][1]) == Counter({k: n for k, n in ids(docs).items() if k not in toxic})
    before, after = seen["decontamination"]
    leaks = {r["doc_id"] for r in decontaminate(before, bench).filter("contaminated").collect()}
    assert ids(after) == Counter({k: n for k, n in ids(before).items() if k not in leaks})
    before, after = seen["mixing"]
    assert set(ids(after)) <= set(ids(before)) and max(ids(after).values()) <= 3
    before, after = seen["sharding"]
    assert ids(before) == ids(after)
    counts = Counter(r["shard"] for r in after.collect())
    assert max(counts.values()) - min(counts.values()) <= 1
    assert {r["slot"] for r in after.filter("shard = 0").collect()} == set(range(counts[0]))


def test_extra_columns_nulls_and_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).selectExpr("*", "1 as row", "2 as shard_of", "3 as id", "4 as part")
    docs = docs.unionByName(docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])).unionByName(docs.limit(1))
    for some in (docs, docs.limit(0)):
        now = spark.createDataFrame(some.collect(), some.schema)
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            now = spark.createDataFrame(now.collect(), now.schema)
            assert now.columns[: len(docs.columns)] == docs.columns, name


def test_chat_sql(spark):
    c = duckdb.connect()
    c.execute("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    want = c.sql(queries.oracle_sql()["op4_chat_formatting"])
    names = sorted(want.columns)
    got = queries.op4_chat_formatting(spark, "/root/testdata/sf0.01")
    assert sorted(got.columns) == names
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.select(*[f'"{n}"' for n in names]).fetchall())
    assert re.search("from conversations", queries.oracle_sql()["op4_chat_formatting"])
