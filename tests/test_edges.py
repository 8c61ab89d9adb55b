"""Nulls, ties, repeated rows, empty tables and clashing columns, for each operator of repair and rolling."""

import pytest
from pyspark.sql import functions as F

from rillwork.operators import filters, repair, rolling, store

ITEMS = "k long, n long, t long, x long, h boolean, m boolean, sig long, place long"
ROWS = [
    (1, 1, 10, 60, True, False, 1, 0), (1, 2, 10, None, None, True, None, 5), (1, 3, None, 60, False, True, 1, 6), (1, 4, 30, 60, False, None, 1, 7),
    (1, 5, 25, 60, True, False, 2, 8), (1, 6, 25, 0, False, True, 2, 9), (1, 6, 25, 0, False, True, 2, 9), (None, 1, 5, 10, None, True, None, 1), (None, 2, None, 10, True, None, None, 2), (3, 1, None, None, None, None, None, None),
]
#: Names that operators use or add; the values tell whether a column is still the caller's.
CLASHING = ("segment", "size", "of_kind", "gop", "local", "shift", "first", "last", "of", "at_", "now", "media", "rises", "part", "new", "island", "offset", "step", "number", "times", "places", "failed", "streak", "ends", "definite", "alive", "since", "starts", "session", "fits", "some", "result", "reason", "kept", "b", "w", "n_", "jump")
C = F.col

#: Operators that add to the items: what they do, and the column they add.
ADDING = {
    "segments": (lambda d: repair.segments(d, "k", "n", C("h")), "segment"),
    "defragment": (lambda d: repair.defragment(d, "k", "n", C("h"), 2), "segment"),
    "first_of_segment": (lambda d: repair.first_of_segment(d, "k", "n", C("h"), C("m")), "segment"),
    "without_duplicates": (lambda d: repair.without_duplicates(d, "k", "n", C("h"), C("m"), ["x"]), "segment"),
    "gop_order": (lambda d: repair.gop_order(d.drop("place"), "k", "n", "t", C("m"), C("h"), C("m")), "place"),
    "time_from_segment_start": (lambda d: repair.time_from_segment_start(d, "k", "n", "t", C("h")), "local"),
    "time_continued": (lambda d: repair.time_continued(d, "k", "n", "t", C("h")), "local"),
    "split_on_change": (lambda d: repair.split_on_change(d, "k", "n", C("h"), "sig"), "part"),
    "byte_offsets": (lambda d: repair.byte_offsets(d, "k", "n", "x"), "offset"),
    "keyframe_index": (lambda d: repair.keyframe_index(d, "k", "n", "t", C("h"), C("h"), C("m"), 5), "times"),
    "consecutive": (lambda d: rolling.consecutive(d, "k", "n", C("m")), "streak"),
    "hysteresis_sessions": (lambda d: rolling.hysteresis_sessions(d, "k", "t", "n", C("m"), C("h"), 5), "session"),
    "ranked_candidates": (lambda d: filters.ranked_candidates(d, "k", C("h"), C("m"), [C("n")]), "place"),
    "keep_newest": (lambda d: store.keep_newest(d, "k", [C("n")], 99), "place"),
}
ADDING["hls_defragmented"] = (lambda d: repair.hls_defragmented(d.withColumn("x", F.lit(1)), "k", "n", "kind", "x", 3), "k")
#: Operators that give rows of their own.
GIVING = {
    "missing_headers": lambda d: repair.missing_headers(d, "k", "n", C("h")),
    "without_replays": lambda d: repair.without_replays(d, "k", "n", "h", "m", "t", "x"),
    "merged_ranges": lambda d: repair.merged_ranges(d, "k", "n", "t"),
    "limited_segments": lambda d: repair.limited_segments(d, "k", "n", "x", 100),
    "limited_media": lambda d: repair.limited_media(d, "k", "n", "t", "x", "m", "h", "h", 100, 50),
    "segment_splits": lambda d: repair.segment_splits(d, "k", "n", "sig", "x", C("h")),
    "thinned": lambda d: repair.thinned(d, "k", "n", "t", 5),
    "timing_repaired": lambda d: repair.timing_repaired(d, "k", "n", "t", 15, 1),
    "offline_signals": lambda d: rolling.offline_signals(d, "k", "t", "n", "m", 50, 2),
    "size_estimates": lambda d: rolling.size_estimates(d, "k", "n", "x", 100),
    "coarsened_rate": lambda d: rolling.coarsened_rate(d, "t", 10),
}


def plain(spark):
    return spark.createDataFrame(ROWS, ITEMS).withColumn("kind", F.when(C("h"), "init").when(C("m"), "media"))


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("name", sorted(ADDING))
def test_adding_operators(spark, name):
    run, added = ADDING[name]
    items = plain(spark)
    small = run(items)
    own = [c for c in items.columns if not (name == "gop_order" and c == "place")]
    assert small.columns[: len(own)] == own
    wide = run(items.select("*", *[F.lit(f"mine-{c}").alias(c) for c in CLASHING]))
    # the caller's columns are the caller's still, and the result is the same
    assert wide.columns[: len(items.columns) - (name == "gop_order") + len(CLASHING)] == own + list(CLASHING)
    got = wide.collect()
    assert got and all(r[c] == f"mine-{c}" for r in got for c in CLASHING)
    last = lambda frame: [] if added in own else [frame.columns[-1]]
    value = lambda frame: sorted(str([r[c] for c in own + last(frame)]) for r in frame.collect())
    assert value(wide) == value(small)
    assert run(items.limit(0)).count() == 0
    assert added in small.columns or f"{added}_" in small.columns


@pytest.mark.parametrize("name", sorted(GIVING))
def test_giving_operators(spark, name):
    items = plain(spark)
    small = GIVING[name](items)
    assert small.count() > 0
    wide = GIVING[name](items.select("*", *[F.lit(f"mine-{c}").alias(c) for c in CLASHING]))
    assert wide.columns == small.columns and rows_of(wide) == rows_of(small)
    assert GIVING[name](items.limit(0)).count() == 0


def test_nulls_by_hand(spark):
    items = plain(spark)
    of = lambda frame, column: {(r["k"], r["n"]): r[column] for r in frame.collect()}
    # a null size is nothing, and splitting goes on
    sizes = spark.createDataFrame([(1, n, x) for n, x in enumerate([60, None, 60, 60, 60])], "k long, n long, x long")
    assert [r["result"] for r in repair.limited_segments(sizes, "k", "n", "x", 100).orderBy("n").collect()] == [0, 0, 1, 2, 3]
    # a null time is never kept, and what follows may be
    times = spark.createDataFrame([(1, n, t) for n, t in enumerate([None, 0, 3, None, 6])], "k long, n long, t long")
    assert [r["result"] for r in repair.thinned(times, "k", "n", "t", 5).orderBy("n").collect()] == [False, True, False, False, True]
    # a null header flag is no header: its item has a time of its own
    local = of(repair.time_from_segment_start(items, "k", "n", "t", C("h")), "local")
    assert local[1, 2] == 0 and local[1, 1] == 0 and local[1, 3] is None and local[None, 1] == 0
    assert of(repair.split_on_change(items, "k", "n", C("h"), "sig"), "part")[1, 6] == 1
    assert of(repair.timing_repaired(items, "k", "n", "t", 15, 1), "result") == {(1, 1): 10, (1, 2): 10, (1, 3): None, (1, 4): 11, (1, 5): 12, (1, 6): 12, (None, 1): 5, (None, 2): None, (3, 1): None}


def test_keyframe_index_fills_the_first_script_only(spark):
    rows = [(1, n, t, h, s, f, 100 * n) for n, (t, h, s, f) in enumerate([(0, True, False, False), (0, False, True, False), (0, False, False, True), (3, False, False, True), (9, False, False, True), (9, False, True, False), (0, True, False, False), (1, False, False, True), (2, False, True, False), (0, True, False, False), (5, False, True, False)])]
    items = spark.createDataFrame(rows, "k long, n long, t long, h boolean, s boolean, f boolean, place long")
    got = {r["n"]: (r["times"], r["places"]) for r in repair.keyframe_index(items, "k", "n", "t", C("h"), C("s"), C("f"), 5).collect()}
    assert got.pop(1) == ([0, 9], [200, 400]) and got.pop(8) == ([1], [700]) and got.pop(10) == ([], [])
    assert set(got.values()) == {(None, None)}


def test_media_limit_splits_at_keyframes(spark):
    frames = [(n, 100 * n, 10, n % 4 == 0, False, n == 0) for n in range(40)]
    walk, size, part, want = [], 0, 0, {}
    for n, _, x, key, _, begins in frames:
        if not begins:
            size += x
            if size >= 60 and key or size >= 120:
                part, size = part + 1, 0
        want[n] = part
        walk.append(part)
    items = spark.createDataFrame([(1, *f) for f in frames], "k long, n long, t long, x long, f boolean, h boolean, b boolean")
    got = repair.limited_media(items, "k", "n", "t", "x", "f", "h", "b", 60).collect()
    assert {r["n"]: r["part"] for r in got} == want and max(walk) > 3
    assert {r["reason"] for r in got} == {None, "size"}
    # without keyframes a part begins at twice the bound
    never = repair.limited_media(items.withColumn("f", F.lit(False)), "k", "n", "t", "x", "f", "h", "b", None, 500).collect()
    starts = [r["n"] for r in sorted(never, key=lambda r: r["n"]) if r["reason"] == "time"]
    assert starts[:2] == [11, 21]


def test_rate_keeps_its_budget_while_it_coarsens(spark):
    """2,260 buckets of 10 s are over the budget of 2,160 points: the width doubles once."""
    rows = spark.range(2260).select((F.col("id") * 10_000_000).alias("t"))
    got = rolling.coarsened_rate(rows, "t", 10)
    assert {r["width_s"] for r in got.collect()} == {20} and got.count() == 1130 and got.agg(F.sum("n")).first()[0] == 2260
    # buckets without rows are no points
    far = spark.range(100).select((F.col("id") * 10_000_000_000).alias("t"))
    assert {r["width_s"] for r in rolling.coarsened_rate(far, "t", 10).collect()} == {10}
