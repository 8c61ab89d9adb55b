"""Sharding: the law, gapless slots, reruns, a uniform order, edge cases."""

import zlib
from collections import Counter

import numpy as np

from rillwork.llm import sharding
from rillwork.llm.sharding import external_shuffle, fisher_yates, shard_documents, shard_manifest, write_shards


def check_rows_law(shards, slots, n):
    counts = Counter(shards)
    assert max(counts[k] for k in range(n)) - min(counts[k] for k in range(n)) <= 1
    for k in range(n):
        assert sorted(s for x, s in zip(shards, slots, strict=True) if x == k) == list(range(counts[k]))


def test_manifest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "1 as shard", "2 as place")
    docs = docs.unionByName(docs.limit(7)).unionByName(spark.createDataFrame([(None, None, 1, 2), (None, "", 1, 2), (5, None, 1, 2)], docs.schema))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    got = shard_manifest(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    check_rows_law([r["shard"] for r in got], [r["slot"] for r in got], 16)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    again = shard_manifest(docs.repartition(13)).collect()
    as_set = lambda rows: sorted((r["shard"], r["slot"], str(r["doc_id"]), r["text_crc32"]) for r in rows)
    assert as_set(got) == as_set(again)


def test_order_is_uniform():
    seen = Counter(tuple(fisher_yates(3, np.random.default_rng(k))) for k in range(6000))
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())
    assert list(fisher_yates(0, np.random.default_rng(0))) == [] and list(fisher_yates(1, np.random.default_rng(0))) == [0]


def test_small_buckets_whole_records_and_files(spark, tmp_path):
    rows = [(i % 50 if i % 3 else None, "t" * (i % 11), [i], "x") for i in range(500)]
    records = spark.createDataFrame(rows, "id long, text string, list array<long>, bucket string")
    out = external_shuffle(records, ["id", "text"], n_shards=7, bucket_bytes=200)
    got = out.collect()
    assert Counter((r["id"], r["text"], tuple(r["list"]), r["bucket"]) for r in got) == Counter((a, b, tuple(c), d) for a, b, c, d in rows)
    check_rows_law([r["shard"] for r in got], [r["slot"] for r in got], 7)
    write_shards(out, f"{tmp_path}/out", 7)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 500


def test_empty_table_and_fewer_rows_than_shards(spark):
    schema = "doc_id long, text string"
    assert shard_manifest(spark.createDataFrame([], schema)).count() == 0
    got = shard_manifest(spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], schema)).collect()
    assert len({(r["shard"], r["slot"]) for r in got}) == 3 and {r["slot"] for r in got} == {0}


def test_manifest_is_of_whole_written_documents(spark, tmp_path):
    rows = [(2**60 + i if i % 5 else None, f"text {i}", [i], f"s{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, list array<long>, slot string")
    got = shard_manifest(docs, path=f"{tmp_path}/shards").collect()
    written = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert Counter((r["doc_id"], r["text"], tuple(r["list"]), r["record_slot"]) for r in written) == Counter((a, b, tuple(c), d) for a, b, c, d in rows)
    place = lambda r: (r["doc_id"], r["shard"], r["slot"])
    assert Counter(map(place, got)) == Counter(map(place, written)) == Counter(map(place, shard_documents(docs.withColumnRenamed("slot", "own")).collect()))
    by_place = {(r["shard"], r["slot"]): r["text"].encode() for r in written}
    assert all((len(t) + 1, zlib.crc32(t)) == (r["size"], r["text_crc32"]) for r in got for t in [by_place[r["shard"], r["slot"]]])


def test_equal_records_are_spread(spark):
    rows = [(None, "same" * 5, 0)] * 600 + [(7, "other", i) for i in range(200)] + [(100 + i, f"text {i}", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    shard = lambda d: shard_documents(d, 4, bucket_bytes=4000).collect()
    got = shard(docs)
    assert Counter((r["doc_id"], r["text"], r["n"]) for r in got) == Counter(rows)
    check_rows_law([r["shard"] for r in got], [r["slot"] for r in got], 4)
    for group, n in ((None, 600), (7, 200)):
        seen = Counter(r["shard"] for r in got if r["doc_id"] == group)
        assert all(n / 8 < seen[k] < n / 2 for k in range(4)), seen
    assert set(got) == set(shard(docs.repartition(5)))


def test_order_does_not_follow_the_shuffle_partitions(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "concat('text ', id) as text")
    seen = []
    for n in (4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, shard_documents(docs).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert seen[0] == seen[1]


def test_many_buckets_and_hot_keys(spark, monkeypatch):
    """64 times the buckets, a thousand keys that would fill one: nothing of either goes through the driver or to all tasks."""
    rows = [(i % 1000, "h" * 40) for i in range(6000)] + [(10_000 + i, "x" * (i % 30)) for i in range(3000)]
    records = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = external_shuffle(records, ["doc_id", "text"], 16, bucket_bytes=200).collect()
    assert Counter((r["doc_id"], r["text"]) for r in want) == Counter(rows)
    check_rows_law([r["shard"] for r in want], [r["slot"] for r in want], 16)
    monkeypatch.setattr(sharding, "LEAST_BUCKETS", 64 * 64)
    monkeypatch.setattr(sharding, "BLOCK", 10)
    monkeypatch.setattr(sharding, "HOT_AT_ONCE", 0)
    got = external_shuffle(records, ["doc_id", "text"], 16, bucket_bytes=200)
    # one row is all that is sent to all tasks
    assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") <= 1
    rows_got = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows_got) == Counter(rows)
    check_rows_law([r["shard"] for r in rows_got], [r["slot"] for r in rows_got], 16)
