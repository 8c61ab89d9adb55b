"""Greedy string tiling against a plain version, reordered passages and edge cases."""

import random

from rillwork.llm.decontamination import MIN_MATCH, decontaminate, without_benchmark


def plain(item, doc):
    """Covered words of the item: the longest unmarked match first, found anew each time."""
    a, b = [False] * len(item), [False] * len(doc)
    while True:
        best = (MIN_MATCH - 1, 0, 0)
        for j in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < MIN_MATCH:
            return sum(a)
        for k in range(n):
            a[i + k] = b[j + k] = True


def test_tiling_and_order(spark):
    rng = random.Random(3)
    item = [f"w{i}" for i in range(40)]
    docs = [(1, item), (2, item[20:] + ["x"] * 5 + item[:20]), (3, item[:12]), (4, item[:25]), (5, [f"z{i}" for i in range(90)])]
    for k in range(6, 20):
        parts = [item[p : p + 8] for p in (0, 8, 16, 24, 32)]
        rng.shuffle(parts)
        docs.append((k, [w for p in parts for w in (*p[: rng.randint(3, 8)], "y")]))
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (None, "a b c d e f")], "item_id long, text string")
    frame = spark.createDataFrame([(i, " ".join(w).upper() + ".") for i, w in docs] + [(50, None), (51, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate(frame, bench).collect()}
    assert len(got) == len(docs) + 2
    for i, words in docs:
        share = plain(item, words) / len(item)
        assert got[i]["contaminated"] == (share >= 0.5)
        assert got[i]["coverage"] == (share if share >= 0.5 else None)
    in_blocks = {r["doc_id"]: r for r in decontaminate(frame, bench, block_bytes=40).collect()}
    assert in_blocks == got
    clashing = frame.selectExpr("*", "1 as c0", "2 as item_id")
    kept = without_benchmark(clashing, bench)
    assert kept.columns == clashing.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["contaminated"]}


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontaminate(docs, none).collect()] == [False]
    assert decontaminate(docs.limit(0), none).count() == 0


def test_rows_stay_rows_and_items_without_an_id_count(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(12)) for c in "abc")
    bench = spark.createDataFrame([(1, one), (None, two), (None, three), (4, three)], "item_id long, text string")
    rows = [(1, one), (1, "clean"), (1, one), (2, two), (None, one), (None, "clean"), (None, three), (3, f"{one} {two}"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(1, True, 1), (1, False, None), (1, True, 1), (2, True, None), (None, True, 1), (None, False, None), (None, True, 4), (3, True, 1), (4, False, None)], key=str)
    for block_bytes in (1 << 20, 20):
        got = decontaminate(docs, bench, block_bytes=block_bytes).collect()
        assert sorted(((r["doc_id"], r["contaminated"], r["item_id"]) for r in got), key=str) == want
        assert all((r["coverage"] == 1.0) if r["contaminated"] else r["coverage"] is None for r in got)
        assert sorted(r["text"] or "" for r in without_benchmark(docs, bench, block_bytes=block_bytes).collect()) == ["", "clean", "clean"]


def test_repetitive_texts_are_bounded_and_exact(spark, monkeypatch):
    from rillwork.llm import decontamination as D

    block = D.block_of([1, 2], [b"same " * 400, b"a b c d e f g h " * 3])
    assert list(D.coverages([b"same " * 200_000], block, 0.5)) == [(0, 1, 1.0)]
    rng = random.Random(5)
    monkeypatch.setattr(D, "PAIRS_AT_ONCE", 7)
    for _ in range(60):
        item, doc = ([rng.choice("ab") for _ in range(n)] for n in (rng.randrange(6, 25), rng.randrange(5, 40)))
        got = list(D.coverages([" ".join(doc).encode()], D.block_of([1], [" ".join(item).encode()]), 0.01))
        want = plain(item, doc) / len(item)
        assert (got[0][2] if got else 0.0) == want
