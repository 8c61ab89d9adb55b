"""Removal of repeated strings against brute force over all windows."""

import hashlib
from pathlib import Path

from rillwork.llm.substring_dedup import remove_repeats


def brute(rows, k=50):
    first = {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        for p in range(len(t) - k + 1):
            first.setdefault(t[p : p + k], i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone, until = [], 0
        for p in range(len(raw)):
            if first.get(raw[p : p + k], i) < i and p + k <= len(raw):
                until = p + k
            gone.append(p < until)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    extra = [(10_001, rows[0][1][:60] + "x" + (rows[1][1] or "")[5:70]), (10_002, "ab" * 200), (10_003, "ab" * 100), (10_004, "a" * 49), (10_005, None), (10_006, "")]
    got = remove_repeats(docs.unionByName(spark.createDataFrame(extra, docs.schema))).drop("kept")
    assert sorted(tuple(r) for r in got.collect()) == brute(rows + extra)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_repeated_rows_long_texts_and_clashing_columns(spark):
    line = "the same line of more than fifty bytes stands in both texts here"
    long = "".join(f"{i * 7919 % 100_003:06d} " for i in range(40_000))
    rows = [(1, line + " one"), (2, "two " + line), (2, "two " + line), (3, long), (4, long[100_000:160_000]), (5, "é" * 30 + line)]
    got = remove_repeats(spark.createDataFrame([(i, t, "x", 0, b"") for i, t in [*rows, (None, "null " + line)]], "doc_id long, text string, stretch string, n_bytes int, kept binary"))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    found = [tuple(r)[:5] for r in got.collect()]
    assert sorted(r for r in found if r[0] is not None) == brute(rows)
    # a null id is larger than any other
    (last,) = [r for r in found if r[0] is None]
    assert last[1:] == brute([*rows, (10**9, "null " + line)])[-1][1:]


def test_leaves_little_on_disk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    size = sum(len((t or "").encode()) for _, t in docs.collect())
    local = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    roots = [*local, spark.conf.get("spark.checkpoint.dir").removeprefix("file://")]
    files = lambda: {p: p.stat().st_size for r in roots for p in Path(r).rglob("*") if p.suffix in (".parquet", ".data")}
    before = files()
    left = remove_repeats(docs)
    # shuffles of the steps are freed, and of their tables only what documents are told stays
    assert sum(n for p, n in files().items() if p not in before) < 0.3 * size
    assert left.count() == docs.count()


def test_periodic_texts_and_many_in_a_chunk(spark):
    period = "abcdefghijklmnopqrstuvwxyz0123456789 " * 40
    rows = [(1, period[5:900]), (2, "x" * 300), (3, "y" + period), (4, "x" * 120 + period[:70] + "x" * 49), (5, "x" * 49)]
    rows += [(i, f"{i:05d} " + period[i % 37 : i % 37 + i % 90] + f" {i * i} " + "a line that many short texts have, 50 bytes and more" * (i % 3 == 0)) for i in range(6, 300)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept")
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
