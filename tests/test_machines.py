"""State machines: over tables against plain walks, and as streams against the table form."""

import random

import pytest
from pyspark.sql import functions as F

from rillwork.operators import machines as M
from rillwork.shared import shared_folder
from rillwork.streaming import machine_stream, run_to_end

SECOND = 1_000_000


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def in_files(spark, rows, schema, parts, root, first=0):
    """Writes each part as a file of its own, in the order that the stream takes them."""
    import time

    for n, part in enumerate(parts, first):
        time.sleep(0.02)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{root}/in/part={n:03d}")


def stream(spark, schema, root):
    source = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    return source.drop("part")


SESSION = "k long, n long, at long, ends boolean, definite boolean"


def session_rows(seed, n=300):
    rng, at, rows = random.Random(seed), 10**12, []
    for i in range(n):
        at += rng.choice([0, 1, 5, 30, 79, 80, 81, 200]) * SECOND
        kind = rng.choice("llead")
        rows.append((rng.choice([1, 2, 3, None]), i, at, kind in "ed", kind == "d"))
    return rows


def plain_sessions(rows, window, until):
    out = []
    for key in {r[0] for r in rows}:
        since = deadline = None
        for _, _, at, ends, definite in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if at > until:
                break
            if deadline is not None and deadline < at:
                out.append((key, since, "ended", deadline, True))
                since = deadline = None
            if not ends and since is None:
                since = at
                out.append((key, at, "started", at, False))
            elif not ends and deadline is not None:
                deadline = None
                out.append((key, since, "resumed", at, True))
            elif definite and since is not None:
                out.append((key, since, "ended", at, deadline is not None))
                since = deadline = None
            elif ends and since is not None and deadline is None:
                deadline = at + window
                out.append((key, since, "ending", at, False))
        if deadline is not None and deadline <= until:
            out.append((key, since, "ended", deadline, True))
    return sorted(out, key=str)


def test_sessions_in_a_table_and_as_a_stream_with_a_restart(spark):
    rows = session_rows(1)
    delay = 100 * SECOND
    until = (max(r[2] for r in rows) - delay) // 1000 * 1000
    machine = M.Sessions("at", "ends", "definite")
    want = plain_sessions(rows, 80 * SECOND, until)
    assert {w[2] for w in want} == {"started", "resumed", "ending", "ended"}
    frame = spark.createDataFrame(rows, SESSION).withColumn("until", F.lit(until))
    assert rows_of(M.walked(frame, "k", ["at", "n"], machine, "at", "until")) == want
    # many batches, disordered within the delay
    rng = random.Random(2)
    mixed = sorted(rows, key=lambda r: r[2] + rng.random() * delay * 0.9)
    parts = [mixed[i : i + 60] for i in range(0, len(mixed), 60)]
    root = shared_folder(spark, "sessions-test")
    in_files(spark, rows, SESSION, parts[:3], root)
    once = machine_stream(stream(spark, SESSION, root), "k", "at", ["n"], machine, "100 seconds")
    first = rows_of(run_to_end(once, "append", root))
    assert 0 < len(first) < len(want)
    # the rest comes after a restart
    in_files(spark, rows, SESSION, parts[3:], root, 3)
    again = machine_stream(stream(spark, SESSION, root), "k", "at", ["n"], machine, "100 seconds")
    assert rows_of(run_to_end(again, "append", root)) == want


def test_a_late_row_is_dropped_and_an_empty_stream_is_empty(spark):
    live = [(1, 0, 10**12, False, False), (1, 1, 10**12 + 10 * SECOND, True, False)]
    later, more = ([(2, n, 10**12 + t * SECOND, False, False)] for n, t in ((2, 500), (5, 510)))
    late = [(1, 3, 10**12 + 20 * SECOND, False, False), (2, 4, 10**12 + 900 * SECOND, False, False)]
    root = shared_folder(spark, "late-test")
    in_files(spark, [], SESSION, [live, later, more, late], root)
    got = machine_stream(stream(spark, SESSION, root), "k", "at", ["n"], M.Sessions("at", "ends", "definite"), "10 seconds")
    found = rows_of(run_to_end(got, "append", root))
    assert (1, 10**12, "ended", 10**12 + 90 * SECOND, True) in found and not any(r[2] == "resumed" for r in found)
    root = shared_folder(spark, "empty-test")
    spark.createDataFrame([], SESSION).write.parquet(f"{root}/in/part=000")
    none = machine_stream(stream(spark, SESSION, root), "k", "at", ["n"], M.Sessions("at", "ends", "definite"), "10 seconds")
    assert rows_of(run_to_end(none, "append", root)) == []
    assert run_to_end(stream(spark, SESSION, root).groupBy("k").count(), "complete").count() == 0


PAIRS = "s string, n long, at long, kind string, ix long, path string"


def pair_rows(seed):
    rng, rows, n = random.Random(seed), [], 0
    for s in range(12):
        base, events = 10**12 + s * 7 * SECOND, []
        for i in range(rng.randrange(5)):
            events += [("video", i, f"/{s}-{i}.flv")] * rng.choice([0, 1, 1, 2]) + [("chat", i, f"/{s}-{i}.xml")] * rng.choice([0, 1, 1])
        events += [(k, None, None) for k in ("chat_started", "chat_stopped", "ended", "persisted") if rng.random() < 0.8]
        rng.shuffle(events)
        for kind, i, path in events:
            rows.append((f"s{s}", n, base + rng.randrange(60) * SECOND, kind, i, path))
            n += 1
    return [*rows, ("last", n, 10**12 + 10_000 * SECOND, "video", None, None)]


def plain_pairs(rows, idle, until):
    out = []
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key and r[2] <= until), key=lambda r: (r[2], r[1]))
        upto, done, complete = [], set(), False
        for r in mine:
            upto.append(r)
            lane = lambda k, i=None: [x[5] for x in sorted((x for x in upto if x[3] == k and x[4] is not None), key=lambda x: x[4]) if i is None or x[4] == i]  # noqa: B023, E731
            once = lambda x: list(dict.fromkeys(x))
            if r[4] is not None and r[4] not in done and lane("video", r[4]) and lane("chat", r[4]):
                done.add(r[4])
                out.append((key, "pair", r[4], once(lane("video", r[4])), once(lane("chat", r[4])), []))
            said = {x[3] for x in upto if x[4] is None}
            chat = lane("chat") or "chat_started" in said
            unmet = [n for n, met in (("ended", "ended" in said), ("persisted", "persisted" in said), ("chat_stopped", not chat or "chat_stopped" in said), ("video", bool(lane("video")))) if not met]
            if not unmet and not complete:
                complete = True
                out.append((key, "complete", None, once(lane("video")), once(lane("chat")), []))
        if mine and not complete and mine[-1][2] + idle <= until:
            out.append((key, "evicted", None, once(lane("video")), once(lane("chat")), unmet))
    return sorted(out, key=str)


def test_pairs_fire_once_and_idle_sessions_are_evicted(spark):
    rows = pair_rows(3)
    delay, idle = 100 * SECOND, 600 * SECOND
    until = max(r[2] for r in rows) - delay
    machine = M.Pairing("at", "kind", "ix", "path", idle)
    want = plain_pairs(rows, idle, until)
    assert {w[1] for w in want} == {"pair", "complete", "evicted"}
    frame = spark.createDataFrame(rows, PAIRS).withColumn("until", F.lit(until))
    assert rows_of(M.walked(frame, "s", ["at", "n"], machine, "at", "until")) == want
    rng = random.Random(5)
    mixed = sorted(rows, key=lambda r: r[2] + rng.random() * delay * 0.9)
    root = shared_folder(spark, "pairs-test")
    in_files(spark, rows, PAIRS, [mixed[i : i + 25] for i in range(0, len(mixed), 25)], root)
    assert rows_of(run_to_end(machine_stream(stream(spark, PAIRS, root), "s", "at", ["n"], machine, "100 seconds"), "append", root)) == want


def test_pairing_waits_for_the_same_index_and_for_chat_to_stop():
    machine, state = M.Pairing("at", "kind", "ix", "path", 10), {}
    step = lambda at, kind, ix=None, path=None: list(machine.step(state, {"at": at, "kind": kind, "ix": ix, "path": path}))
    assert step(1, "video", 0, "/0.flv") == [] and step(2, "chat", 1, "/1.xml") == []
    assert step(3, "chat", 0, "/0.xml") == [("pair", 0, ["/0.flv"], ["/0.xml"], [])]
    assert step(4, "video", 0, "/0b.flv") == []
    assert step(5, "ended") == [] and step(6, "persisted") == []
    assert step(7, "chat_stopped") == [("complete", None, ["/0.flv", "/0b.flv"], ["/0.xml", "/1.xml"], [])]
    assert step(8, "ended") == [] and machine.due(state) == 18 and list(machine.wake(state, 18)) == [] and state == {}


SEGMENTS = "k long, n long, at long, kind string, number long, to long, size long, init string"


def test_assembler_under_shuffled_arrivals(spark):
    """Whatever the order of arrival, nothing is lost or given twice, and what is given is in order."""
    rng = random.Random(8)
    rows, want = [], {}
    for key in range(6):
        dead = set(rng.sample(range(60), 6))
        numbers = [i for i in range(60) if i not in dead]
        sent = sorted(numbers, key=lambda i: i + rng.random() * 4)
        events = [("media", i, None, 10, "a" if key % 2 else None) for i in sent] + [("dead", i, None, None, None) for i in dead]
        events = sorted(events, key=lambda e: e[1] + rng.random() * 8)
        events.insert(rng.randrange(5), ("init", 0, None, None, "a"))
        rows += [(key, n, 1000 * n, *e) for n, e in enumerate(events)]
        want[key] = numbers
    frame = spark.createDataFrame(rows, SEGMENTS)
    machine = M.Assembler("at", "kind", "number", "to", "size", "init", skip_count=None)
    got = M.walked(frame, "k", ["n"], machine).collect()
    for key, numbers in want.items():
        mine = [r for r in got if r["k"] == key]
        assert [r["number"] for r in mine if r["what"] == "media"] == numbers
        assert {i for r in mine if r["what"] == "skip" for i in range(r["number"], r["to"] + 1)} == set(range(60)) - set(numbers)
        said = [r["what"] for r in mine if r["what"] != "skip"]
        assert said.count("init") == 1 and (key % 2 == 0 or said[0] == "init")


def drive(machine, events):
    state, out = machine.start(), []
    for at, kind, number, to, size, init in events:
        out += M.woken(machine, state, at)
        out += machine.step(state, {"at": at, "kind": kind, "number": number, "to": to, "size": size, "init": init})
    return out, state


@pytest.mark.parametrize(
    ("options", "events", "want"),
    [
        # three numbers beyond a gap give it up
        ({"skip_count": 3}, [(0, "media", 0, None, 1, None), *[(i, "media", i, None, 1, None) for i in (2, 3, 4)]], [("media", 0), ("skip", 1, "count"), ("media", 2), ("media", 3), ("media", 4)]),
        # a timer gives it up, without a row to come
        ({"skip_count": None, "skip_us": 50}, [(0, "media", 1, None, 1, None), (200, "init", None, None, None, "x")], [("skip", 0, "time"), ("media", 1)]),
        # media wait for their init; a failed init makes them dead
        ({}, [(0, "media", 0, None, 1, "a"), (1, "media", 1, None, 1, "b"), (2, "init", 0, None, 1, "a"), (3, "failed", None, None, None, "b")], [("init", 0, "a"), ("media", 0), ("skip", 1, "upstream")]),
        # a gap that closed has no timer, though its media waits for its init
        ({"skip_count": None, "skip_us": 50}, [(0, "media", 1, None, 1, None), (10, "media", 0, None, 1, "a"), (500, "media", 2, None, 1, None)], []),
        # not before the first media of a stream that needs inits
        ({"skip_count": 1}, [(0, "init", 0, None, 1, "a"), (1, "media", 5, None, 1, "a"), (2, "media", 6, None, 1, "a")], []),
        # a full buffer doesn't wait
        ({"skip_count": None, "most": 2}, [(0, "media", 3, None, 1, None), (1, "media", 4, None, 1, None)], [("skip", 0, "pressure"), ("media", 3), ("media", 4)]),
        # stale and dead numbers
        ({"first": 5}, [(0, "media", 4, None, 1, None), (1, "dead", 5, 7, None, None), (2, "media", 6, None, 1, None), (3, "media", 8, None, 1, None)], [("stale", 4, None), ("skip", 5, "upstream"), ("stale", 6, None), ("media", 8)]),
    ],
)
def test_assembler_rules(options, events, want):
    out, _ = drive(M.Assembler("at", "kind", "number", "to", "size", "init", **options), events)
    assert [(w, n) if w == "media" else (w, n, r) for w, n, _, r in out] == want


def test_planner_decides_once():
    machine, state = M.Planner("snap", "first", "usable"), {}
    step = lambda snap, first, usable: [x[1:] for x in machine.step(state, {"snap": snap, "first": first, "usable": usable})]
    assert step(0, 10, [True, True, False, False, True]) == [("plan", 10, 11), ("skipped", 12, 13), ("plan", 14, 14)]
    assert step(1, 12, [True, True, True, True]) == [("plan", 15, 15)]
    assert step(2, 12, [True, True, True, True]) == []
    assert step(3, 20, [True, None]) == [("missing", 16, 19), ("plan", 20, 20), ("skipped", 21, 21)]
    assert step(4, 15, [True, True]) == [("stale", 15, 16)]
    assert step(5, None, None) == [] and step(6, 22, []) == []
    assert step(7, 3, [True, True]) == [("reset", 3, 4)] and step(8, 30, [True]) == []


def test_planner_against_a_plain_walk(spark):
    rng = random.Random(7)
    rows = []
    for key in range(5):
        first = rng.randrange(100)
        for snap in range(40):
            first = max(0, first + rng.choice([0, 0, 1, 2, 3, 9, -4]))
            rows.append((key, snap, first, [rng.random() < 0.7 for _ in range(6)]))
    frame = spark.createDataFrame(rows, "k long, snap long, first long, usable array<boolean>")
    got = M.walked(frame, "k", ["snap"], M.Planner("snap", "first", "usable")).collect()
    for key in range(5):
        decided, mark = {}, None
        for _, snap, first, usable in [r for r in rows if r[0] == key]:
            if mark is not None and first > mark:
                decided |= {i: (snap, "missing") for i in range(mark, first)}
            if mark is None or first + len(usable) >= mark:
                for i, good in enumerate(usable, first):
                    if mark is None or i >= mark:
                        decided[i] = (snap, "plan" if good else "skipped")
                mark = max(mark or 0, first + len(usable))
        spans = [(i, (r["snapshot"], r["what"])) for r in got if r["k"] == key and r["what"] not in ("stale", "reset") for i in range(r["number"], r["to"] + 1)]
        assert len(spans) == len(decided) and dict(spans) == decided


def test_replays_go_and_genuine_repeats_stay(spark):
    rng = random.Random(6)
    line = [(i * 40, f"c{i}" if rng.random() < 0.9 else "same") for i in range(200)]
    replay = [(t - 2900, c) for t, c in line[100:200]]  # an offset, after a jump back of over 2 s
    items = [(None, None, True, False), *[(t, c, False, True) for t, c in line], *[(t, c, False, True) for t, c in replay], *[(9000 + i * 40, f"d{i}", False, True) for i in range(50)]]
    rows = [(1, n, h, m, t, c) for n, (t, c, h, m) in enumerate(items)]
    # exact repeats, a repeat after a header, nulls
    rows += [(2, n, h, m, t, c) for n, (t, c, h, m) in enumerate([(5, "a", False, True), (5, "a", False, True), (6, "a", False, True), (0, "h", True, False), (5, "a", False, True), (None, "a", None, True), (7, None, False, None)])]
    frame = spark.createDataFrame(rows, "k long, n long, header boolean, media boolean, t long, c string")
    got = {(r["k"], r["number"]): r["kept"] for r in M.walked(frame, "k", ["n"], M.Replay("n", "header", "media", "t", "c")).collect()}
    assert [got[2, n] for n in range(7)] == [True, False, True, True, True, True, True]
    assert all(got[1, n] for n in range(201)) and all(got[1, n] for n in range(301, 351))
    # until the offset is learnt from the first item with one time only, items whose payload came again since are kept
    assert sum(got[1, n] for n in range(201, 301)) <= 1
    small = {r["number"]: r["kept"] for r in M.walked(frame.filter("k = 1"), "k", ["n"], M.Replay("n", "header", "media", "t", "c", capacity=10)).collect()}
    assert sum(small[n] for n in range(201, 301)) > 80


def test_size_estimate_by_hand(spark):
    rows = [(1, n, x) for n, x in enumerate([None, 0, 400, 0, 800])]
    got = M.walked(spark.createDataFrame(rows, "k long, n long, x long"), "k", ["n"], M.Estimate("n", "x", 100))
    assert [r["estimate"] for r in got.orderBy("n").collect()] == [100, 100, 175, 175, 331]


def test_windows():
    assert M.hysteresis_window_us() == 80 * SECOND
    assert M.hysteresis_window_us(0, 10) == 2 * SECOND and M.hysteresis_window_us(10, 600_000) == 300 * SECOND
