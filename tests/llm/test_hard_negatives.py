"""The join for hard negatives against brute force."""

import math
import random

import pytest

from rillwork.llm import hard_negatives as H
from rillwork.llm.queries import op12_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SF = "/root/testdata/sf0.001"


def plain(rows):
    kept = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    place = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, (i, label, v) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), j, m) for n, (j, m, w) in enumerate(kept) if n != k]
        for p, j, _ in sorted((s for s in scored if s[2] == label), key=place)[:5]:
            fits = sorted((s for s in scored if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p), key=place)[:5]
            out += [(i, j, rank, n, p, s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


def cases(n=600, width=8, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    near = lambda: [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]
    rows = [(5 * i, near(), rng.randrange(4)) for i in range(n)]
    hot = [0.5] * width
    rows += [(10_000 + i, hot, i % 3) for i in range(n // 3)]
    rows += [(None, near(), 1), (None, hot, 2), (100, near(), None), (200, None, 1), (300, [math.nan] * width, 1), (400, [None] + [1.0] * (width - 1), 1), (500, [math.inf] * width, 1)]
    rows += [(20_000, [], 1), (20_100, near()[:3], 2), (20_200, near(), 77)] + [(20_300, near(), 2)] * 3
    return [(i, v and [None if x is None else float(f"{x:.4f}") if math.isfinite(x) else x for x in v] if v is not None else None, c) for i, v, c in rows]


def collected(frame):
    assert frame.columns == list(COLUMNS)
    return sorted(map(tuple, frame.collect()), key=str)


def as_float(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame, [tuple(r) for r in frame.collect()]


@pytest.mark.parametrize(("pivots", "group", "slice_"), [(64, 131_072, 1024), (5, 3, 40), (1, 1, 17)])
def test_equals_brute_force(spark, monkeypatch, pivots, group, slice_):
    monkeypatch.setattr(H, "PIVOTS", pivots)
    monkeypatch.setattr(H, "GROUP", group)
    monkeypatch.setattr(H, "SLICE", slice_)
    frame, rows = as_float(spark, cases())
    got = H.hard_negatives(frame.selectExpr("*", "1 as row", "2 as side", "3 as cell", "4 as v").repartition(4))
    want = plain(rows)
    assert len(want) > 50 and collected(got) == want


def test_large_components_and_scores(spark):
    rng = random.Random(9)
    for scale in (300.0, 1e6):
        frame, rows = as_float(spark, [(20 * i, [rng.choice([1, -1]) * scale * (1 + rng.random() / 8) if k else scale for k in range(4)], i % 3) for i in range(200)])
        assert collected(H.hard_negatives(frame)) == plain(rows)
    frame, _ = as_float(spark, [(100 * i, [3e38, -3e38], i % 3) for i in range(9)])
    assert all(r["negative_score"] == r["positive_score"] for r in H.hard_negatives(frame).collect())


def test_bounds_leave_rows_out(spark):
    """Of far clusters, rows go only to groups that they might serve."""
    rng = random.Random(4)
    rows = [(2 * i, [20.0 * (k == i % 6) + rng.gauss(0, 0.3) for k in range(6)], i % 2) for i in range(1200)]
    frame, rows = as_float(spark, rows)
    assert collected(H.hard_negatives(frame)) == plain(rows)
    kept = H.integer_rows(frame, 7, 100).selectExpr("*", "monotonically_increasing_id() as row", "cast(0 as long) as side").cache()
    most = float(kept.agg({"norm": "max"}).first()[0])
    pivots = H._chain(H.np.array([r["v"] for r in kept.orderBy("row").limit(6).collect()]))
    near, far = H._placed(kept, pivots, most, False), H._placed(kept.filter("anchor"), pivots, most, True)
    copies, _ = H._dealt(near, far.selectExpr("row", "vec_id as anchor_id", "label", "v", "norm", "cell", "far", "side", "2000D as reach"), most)
    assert 0 < copies.count() <= 1200
    one = far.filter("vec_id = 0").selectExpr("row", "vec_id as anchor_id", "label", "v", "norm", "cell", "far", "side", "2000D as reach")
    assert H._dealt(near, one, most)[0].count() < 600


def test_query_on_whole_table_and_empty(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert collected(op12_hard_negatives(spark, SF)) == plain(rows)
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
