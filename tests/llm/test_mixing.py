"""Mixing: targets and seats against brute force, caps, reruns, edge cases."""

import re
from collections import Counter, defaultdict

import pytest

from rillwork.llm.mixing import mix, mixed_documents, shard_quotas, source_targets

SCHEMA = "doc_id long, source string, text string, rank int, size string"


def targets_of(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in names if s not in capped)
        out = {s: 3.0 * sizes[s] if s in capped else weight[s] * left / open_weight for s in names}
        over = {s for s in names if s not in capped and out[s] > 3 * sizes[s]}
        if not over:
            return out
        capped |= over


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "source", "text", "1 as rank", "'x' as size")
    extra = [(-1, None, "a b c", 1, ""), (-2, None, None, 1, ""), (-3, "tiny", "one", 1, ""), (-4, "tiny", "one", 1, ""), (-4, "tiny", "one", 1, ""), (-5, "void", "", 1, ""), (None, "tiny", "two words", 1, "")]
    docs = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    rows = docs.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    want = targets_of(sizes)
    by_id = {r["doc_id"]: r["source"] for r in rows}
    got, total = mix(docs).collect(), sum(sizes.values())
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r["doc_id"], size(r["text"])) for r in rows)
    taken = defaultdict(int)
    for r in got:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= len(sizes) * max(1, total // (16 * 1024)) + 1, s
    key = lambda rs: sorted((str(r["doc_id"]), r["taken"]) for r in rs)
    assert key(mix(docs.repartition(11)).collect()) == key(got)


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 1000, "c": 1000}, {"a": 10, "b": 5000, "c": 300, "d": 7, "e": 900}, {"a": 1}])
def test_seats_are_sainte_lague(spark, sizes):
    sized = spark.createDataFrame(list(sizes.items()), "source string, size long")
    quotas = shard_quotas(source_targets(sized), n_shards=4, blocks_per_shard=8).collect()
    target, block = targets_of(sizes), max(1, sum(sizes.values()) // 32)
    seats, names = Counter(), sorted(sizes)
    for _ in range(sum(sizes.values()) // block):
        seats[max(names, key=lambda s: (target[s] / (2 * seats[s] + 1), -names.index(s)))] += 1
    got = Counter()
    for r in quotas:
        assert r["blocks"] >= 0
        got[r["source"]] += r["blocks"]
    assert {s: got[s] for s in names} == {s: seats[s] for s in names}


def test_whole_documents_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * (1 + i % 5), 1, "x") for i in range(400)], SCHEMA)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert max(Counter(r["doc_id"] for r in out.collect()).values()) <= 3
    assert mix(docs.limit(0)).count() == 0
    (only,) = mix(spark.createDataFrame([(1, None, None, 1, None)], SCHEMA)).collect()
    assert (only["size"], only["source_size"], only["taken"]) == (0, 0, 0)


def test_small_sources_are_served_beside_a_large_one(spark):
    docs = [(i, "big", "w " * 5000, 1, "x") for i in range(200)] + [(1000 + i, "mid", "w " * 11, 1, "x") for i in range(9)] + [(2000 + i, "small", "w w", 1, "x") for i in range(4)]
    frame = spark.createDataFrame(docs, SCHEMA)
    want = targets_of({"big": 1_000_000, "mid": 99, "small": 8})
    source, taken = {d[0]: d[1] for d in docs}, Counter()
    for r in mix(frame).collect():
        taken[source[r["doc_id"]]] += r["taken"]
    for s, target in want.items():
        assert abs(taken[s] - target) <= 0.05 * target + 1, s
    times = Counter(r["doc_id"] for r in mixed_documents(frame).collect())
    assert {times[d[0]] for d in docs if d[1] != "big"} == {3}


def test_each_shard_gets_its_quota(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], "w " * (1 + i % 7), 1, "x") for i in range(3000)], SCHEMA)
    source, rows = {r["doc_id"]: r["source"] for r in docs.collect()}, mix(docs, n_shards=4, blocks_per_shard=256).collect()
    sized = spark.createDataFrame([(source[r["doc_id"]], r["size"]) for r in rows], "source string, size long")
    quotas = shard_quotas(source_targets(sized), 4, 256, 256).collect()
    inside, over = Counter(), Counter()
    for r in rows:
        assert (r["first_shard"] is None) == (r["taken"] == 0)
        if r["taken"]:
            for shard in {r["first_shard"], r["last_shard"]}:
                over[source[r["doc_id"]], shard] += r["taken"]
            if r["first_shard"] == r["last_shard"]:
                inside[source[r["doc_id"]], r["first_shard"]] += r["taken"]
    for q in quotas:
        at = q["source"], q["shard"]
        assert inside[at] - 3 * q["block"] <= q["blocks"] * q["block"] <= over[at] + 3 * q["block"], at
