"""Task graphs with faults, and walks by key, against plain versions."""

import random

from rillwork.operators import filters, graph, ordered, repair, rolling, store

SCHEMA = "dag long, step long, deps array<long>, status string, outputs array<string>"


def test_problems_and_levels(spark):
    rows = [(1, 1, [], "COMPLETED", ["a"]), (1, 2, [1], "PENDING", ["b"]), (1, 3, [2, 1], "PENDING", ["a"]), (2, 1, [2], "PENDING", []), (2, 2, [1], "PENDING", [])]
    rows += [(3, 1, None, "FAILED", ["x"]), (3, 2, [9], "PENDING", ["y"]), (4, 1, [], "COMPLETED", []), (4, 1, [], "COMPLETED", []), (5, 1, [], "PENDING", None), (5, 2, [3, 1], "PENDING", []), (5, 3, [2], "PENDING", [])]
    steps = spark.createDataFrame(rows, SCHEMA)
    dags = spark.createDataFrame([(d,) for d in range(1, 7)], "dag long")
    for at_once in (100_000, 0):
        got = sorted((r["dag"], r["problem"]) for r in graph.problems(steps, dags, at_once).collect())
        assert got == [(2, "cycle"), (2, "no root"), (3, "missing"), (4, "duplicate"), (5, "cycle"), (6, "empty")]
        assert {(r["dag"], r["step"]): r["level"] for r in graph.levels(steps, at_once).collect()} == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (3, 1): 0, (3, 2): 0, (4, 1): 0, (5, 1): 0}
    assert sorted((r["dag"], r["step"]) for r in graph.ready(steps).collect()) == [(1, 2), (5, 1)]
    assert {(r["dag"], r["step"]): r["inputs"] for r in graph.fan_in(steps).collect() if r["dag"] == 1} == {(1, 2): ["a"], (1, 3): ["b", "a"]}
    assert {r["dag"]: r["status"] for r in graph.completion(steps).collect()} == {1: "PROCESSING", 2: "PROCESSING", 3: "PROCESSING", 4: "COMPLETED", 5: "PROCESSING"}
    assert graph.levels(steps.limit(0)).count() == 0


def test_a_long_chain_has_all_its_levels(spark):
    """No depth is too deep, in one task or level by level; a diamond takes the longest way."""
    chain = [(1, k, [k - 1] if k else [], "PENDING", []) for k in range(200)]
    steps = spark.createDataFrame(chain, SCHEMA).selectExpr("*", "1 as level", "2 as n")
    assert {r["step"]: r["level"] for r in graph.levels(steps).collect()} == {k: k for k in range(200)}
    assert graph.problems(steps).count() == 0
    short = spark.createDataFrame([(2, k, [k - 1] if k else [], "PENDING", []) for k in range(9)] + [(2, 9, [0, 8], "PENDING", [])], SCHEMA)
    assert {r["step"]: r["level"] for r in graph.levels(short, 3).collect()} == {k: k for k in range(10)}


def test_walks_by_key(spark):
    rng = random.Random(4)
    rows = [(k, n, rng.randrange(1, 60), rng.random() < 0.6) for k in range(5) for n in range(40)]
    frame = spark.createDataFrame(rows, "k long, n long, x long, bad boolean")
    limit, thin, signals = {}, {}, []
    for key in range(5):
        part = held = 0
        kept, log = None, []
        for _, n, x, bad in [r for r in rows if r[0] == key]:
            if held and held + x > 100:
                part, held = part + 1, 0
            held += x
            limit[key, n] = part
            at = n * 10
            thin[key, n] = kept is None or at - kept >= 35
            kept = at if thin[key, n] else kept
            log = [t for t in log if n - t < 6] + [n] if bad else []
            if len(log) >= 3:
                signals.append((key, n))
                log = []
    assert {(r["k"], r["n"]): r["result"] for r in repair.limited_segments(frame, "k", "n", "x", 100).collect()} == limit
    assert {(r["k"], r["n"]): r["result"] for r in repair.thinned(frame.selectExpr("k", "n", "n * 10 as at"), "k", "n", "at", 35).collect()} == thin
    assert sorted(map(tuple, rolling.offline_signals(frame.selectExpr("*", "n as at"), "k", "at", "n", "bad", 6, 3).collect())) == signals
    assert repair.limited_segments(frame.limit(0), "k", "n", "x", 100).count() == 0


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, "a"), (1, 5, None), (None, 1, "b"), (None, 2, "b")]
    frame = spark.createDataFrame(rows, "k long, n long, v string").selectExpr("*", "7 as before", "8 as changed", "9 as starts")
    got = ordered.without_repeats(frame, "k", [frame["n"]], "v")
    assert got.columns == frame.columns
    assert sorted(((r["k"], r["n"]) for r in got.collect()), key=str) == [(1, 1), (1, 3), (1, 5), (None, 1)]
    assert ordered.sessions(frame, "k", "n", "n", 1).columns == [*frame.columns, "session"]
    assert {r["k"]: r["v"] for r in store.keep_last_set(frame, "k", "n", "v").collect()} == {1: "a", None: "b"}
    assert {r["k"]: r["v"] for r in store.replace_all(frame, "k", "n", "v").collect()} == {1: None, None: "b"}
    assert filters.cron_field("*/20,5-7,50", 0, 59) == [0, 5, 6, 7, 20, 40, 50]
    assert frame.filter(filters.conjunction(None, filters.one_of("k", []), filters.search("A", "v"))).count() == 2
