"""Schedules over zones against a search minute by minute, and words against their rules."""

import random
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillwork.operators import chat, hitters, schedules, words
from rillwork.operators.machines import walked

DAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
#: Days around both changes of the clock.
SPANS = {"Europe/Berlin": ((2024, 3, 29), (2024, 10, 25)), "America/New_York": ((2024, 3, 8), (2024, 11, 1))}


def us(t):
    return int(t.timestamp()) * 1_000_000 + t.microsecond


def local(t, zone):
    return datetime.fromtimestamp(t / 1e6, UTC).astimezone(ZoneInfo(zone))


def plain_in(t, days, start, end, zone):
    here = local(t, zone)
    day, now = DAYS[(here.weekday() + 1) % 7], here.strftime("%H:%M:%S")
    before = DAYS[here.weekday()]
    s, e = start + ":00", end + ":00"
    if s <= e:
        return day in days and s <= now < e
    return (now >= s or now < e) if day in days else before in days and now < e


def minutes_by_clock(zone, first, n):
    """(instant, local clock) of every minute."""
    t0 = us(datetime(*first, tzinfo=UTC))
    return [(t0 + k * 60_000_000, local(t0 + k * 60_000_000, zone).replace(tzinfo=None)) for k in range(n * 1440)]


@pytest.mark.parametrize("zone", sorted(SPANS))
def test_window_edges_over_both_changeovers(spark, zone):
    rng = random.Random(zone)
    windows = [(DAYS, "02:30", "03:30"), (("Sun", "Fri"), "22:15", "02:30"), (DAYS, "01:30", "01:45"), (("Sat", "Sun", "Mon"), "00:00", "02:05")]
    for first in SPANS[zone]:
        clock = minutes_by_clock(zone, first, 14)
        of = {}
        for t, c in clock:
            of.setdefault(c, []).append(t)
        asked = sorted(rng.choice(clock[: 5 * 1440])[0] + rng.randrange(60) * 1_000_000 for _ in range(150))
        frame = spark.createDataFrame([(t,) for t in [*asked, None]], "t long")
        for days, start, end in windows:
            got = frame.select("t", schedules.in_window(F.col("t"), days, start, end, zone).alias("in"), schedules.next_opening(F.col("t"), days, start, zone).alias("opens"), schedules.next_closing(F.col("t"), days, start, end, zone).alias("closes")).collect()
            hours = lambda x: timedelta(hours=int(x[:2]), minutes=int(x[3:]))
            for r in got:
                t = r["t"]
                if t is None:
                    assert r["opens"] is None and r["closes"] is None
                    continue
                here = local(t, zone).replace(tzinfo=None)
                midnight = here.replace(hour=0, minute=0, second=0)
                opens = [of[d + hours(start)][0] for d in (midnight + timedelta(days=k) for k in range(8)) if len(of.get(d + hours(start), ())) == 1 and DAYS[(d.weekday() + 1) % 7] in days]
                assert r["opens"] == min((o for o in opens if o > t), default=None), (zone, local(t, zone), start)
                inside = plain_in(t, days, start, end, zone)
                assert r["in"] == inside
                if not inside:
                    assert r["closes"] is None
                    continue
                anchor = midnight + timedelta(days=1) if start > end and DAYS[(here.weekday() + 1) % 7] in days else midnight
                closes = anchor + hours(end)
                while closes not in of:
                    closes += timedelta(minutes=1)
                assert r["closes"] == of[closes][-1], (zone, local(t, zone), end)


def test_window_edges_of_many_rows_are_found_by_day(spark):
    """100,000 rows over both changes of the clock, against the clock of each minute; row by row this took minutes."""
    zone, days, start, end = "Europe/Berlin", ("Sun", "Mon", "Sat"), "22:15", "02:30"
    for first in SPANS[zone]:
        t0 = us(datetime(*first, tzinfo=UTC))
        step = 14 * 86_400_000_000 // 50_000
        rows = spark.range(0, 50_000, 1, 1).select((t0 + F.col("id") * step).alias("t"), F.lit(1).alias("day"), F.lit("x").alias("Opens")).unionByName(spark.createDataFrame([(None, 2, "y")], "t long, day int, Opens string"))
        edges = schedules.window_edges(rows, "t", days, start, end, zone)
        assert edges.columns == ["t", "day", "Opens", "inside", "opens_", "closes"]
        got = {r["t"]: r for r in edges.collect()}
        assert len(got) == 50_001 and tuple(got.pop(None)) == (None, 2, "y", None, None, None)
        # openings and closings of the time around, by the clock of each minute
        opens, closes, seen = [], {}, {}
        for u, c in minutes_by_clock(zone, (datetime(*first) - timedelta(days=2)).timetuple()[:3], 25):
            seen.setdefault(c, []).append(u)
        for c, of in seen.items():
            if c.strftime("%H:%M") == start and DAYS[(c.weekday() + 1) % 7] in days and len(of) == 1:
                opens.append(of[0])
        opens.sort()
        for d in {c.date() for c in seen}:
            c = datetime(d.year, d.month, d.day, 2, 30)
            while c not in seen and c.hour < 6:
                c += timedelta(minutes=1)
            closes[d] = seen.get(c, [None])[-1]
        for t, r in got.items():
            here = local(t, zone)
            inside = plain_in(t, days, start, end, zone)
            closing = closes[here.date() + timedelta(days=DAYS[(here.weekday() + 1) % 7] in days)] if inside else None
            assert (r["inside"], r["opens_"], r["closes"]) == (inside, next(o for o in opens if o > t), closing), here
    assert schedules.window_edges(rows.limit(0), "t", days, start, end, zone).count() == 0


@pytest.mark.parametrize("zone", [*sorted(SPANS), "UTC"])
@pytest.mark.parametrize("cron", ["*/20 1-3 * * *", "0 30 2 * * Sun", "5 * * 3-4,10-11 *", "* 0-23 * * 0,6", "0 0 12 1 * ?", "59 23 * * *"])
def test_cron_edges_over_both_changeovers(spark, zone, cron):
    rng = random.Random(cron)
    fields = cron.split()
    six = len(fields) == 6
    minute, hour, day, month, week = fields[-5:]
    value = lambda f, lo, hi: {v for p in f.replace("?", "*").split(",") for v in (range(lo, hi + 1) if p[0] == "*" else range(int(p.split("-")[0]), int(p.split("-")[-1]) + 1)) if "/" not in p or (v - lo) % int(p.split("/")[1]) == 0}
    sets = [value(minute, 0, 59), value(hour, 0, 23), value(day, 1, 31), value(month, 1, 12), {0} if week == "Sun" else value(week, 0, 6)]
    assert schedules.cron_parts(cron)[1] == [sorted(s) for s in sets]
    fits = lambda c: c.minute in sets[0] and c.hour in sets[1] and c.day in sets[2] and c.month in sets[3] and (c.weekday() + 1) % 7 in sets[4]
    for first in SPANS.get(zone, ((2024, 2, 27),)):
        clock = minutes_by_clock(zone, first, 16)
        hit = [fits(c) for _, c in clock]
        asked = [(k, clock[k][0] + rng.randrange(60_000_000)) for k in rng.sample(range(6 * 1440), 60)]
        frame = spark.createDataFrame([(t,) for _, t in asked] + [(None,)], "t long").selectExpr("*", "7 as day", "8 as runs")
        got = schedules.cron_edges(frame, "t", cron, zone)
        assert got.columns == ["t", "day", "runs", "matches", "next_match", "next_unmatch"]
        by = {r["t"]: r for r in got.collect()}
        assert by.pop(None)["next_match"] is None
        for k, t in asked:
            limit = range(k + 1, k + 8 * 1440 + 1)
            follow = next((clock[j][0] for j in limit if hit[j]), None)
            end = next((clock[j][0] for j in limit if not hit[j]), None) if hit[k] else None
            assert (by[t]["matches"], by[t]["next_match"], by[t]["next_unmatch"]) == (hit[k], follow, end), (six, zone, clock[k])
    assert schedules.cron_edges(frame.limit(0), "t", cron, zone).count() == 0


def test_segmented_words_have_two_characters(spark):
    """Full-width punctuation and symbols separate words, and words of a run are those of the dictionary."""
    dictionary = spark.createDataFrame([("加油", 50), ("主播", 40), ("牛逼", 30), ("今天", 90), ("厉害", 60), ("好", 200), ("天好", 1), ("啊", 100), ("研究", 20), ("研究生", 5), ("生命", 20), ("起源", 10), ("", 3), ("主播", None)], "word string, n long")
    texts = spark.createDataFrame([("a", "加油，主播！加油"), ("a", "主播。牛逼🤣牛逼"), ("b", "主播今天好厉害啊 Good game, gg THE Game2"), ("b", None), ("c", "研究生命起源"), ("c", ""), (None, "加油abc")], "k string, text string")
    got = {(r["k"], r["word"]): r["n"] for r in words.segmented_words(texts, dictionary, "k").collect()}
    assert got == {("a", "加油"): 2, ("a", "主播"): 2, ("a", "牛逼"): 2, ("b", "主播"): 1, ("b", "今天"): 1, ("b", "厉害"): 1, ("b", "good"): 1, ("b", "game"): 1, ("b", "game2"): 1, ("c", "研究"): 1, ("c", "生命"): 1, ("c", "起源"): 1, (None, "加油"): 1}
    assert {r["word"]: r["n"] for r in words.segmented_words(texts, dictionary).collect()}["主播"] == 3
    assert words.segmented_words(texts.limit(0), dictionary).count() == 0
    with pytest.raises(ValueError, match="more than 3 words"):
        words.segmented_words(texts, dictionary, most=3)
    # without words in other scripts it is what unicode_words gives
    latin = texts.filter("k = 'b'").withColumn("text", F.regexp_replace("text", "[一-鿿]+", " "))
    assert {tuple(r) for r in words.segmented_words(latin, dictionary).collect()} == {tuple(r) for r in chat.unicode_words(latin).collect()}


def test_lattice_takes_the_likeliest_cut():
    rng = random.Random(5)
    counts = {"".join(rng.choices("甲乙丙丁", k=rng.randrange(1, 4))): rng.randrange(1, 50) for _ in range(25)}
    lattice = words.Lattice(counts)

    def every(run):
        if not run:
            yield []
        for j in range(1, len(run) + 1):
            if j == 1 or run[:j] in counts:
                for rest in every(run[j:]):
                    yield [run[:j], *rest]

    score = lambda cut: sum(lattice.known.get(w, lattice.unknown) for w in cut)
    for _ in range(200):
        run = "".join(rng.choices("甲乙丙丁戊", k=rng.randrange(1, 9)))
        cut = lattice.cut(run)
        assert "".join(cut) == run and score(cut) == pytest.approx(max(map(score, every(run))))


def test_heavy_hitters_hold_their_bounds(spark):
    """20,000 users and a few hot ones through 80 counters: the true count lies in [n - error, n]."""
    rng = random.Random(3)
    rows = [(f"user-{i % 20_000}", 1 + i % 3) for i in range(40_000)] + [(f"hot-{i % 3}", 2) for i in range(12_000)]
    rng.shuffle(rows)
    true = {}
    for k, n in rows:
        true[k] = true.get(k, 0) + n
    frame = spark.createDataFrame([*rows, (None, 5)], "u string, w long").repartition(4)
    got = [(r["u"], r["n"], r["error"]) for r in hitters.heavy_hitters(frame, "u", 80, "w").collect()]
    assert 0 < len(got) <= 80 and all(n - e <= true[u] <= n for u, n, e in got)
    assert {u for u, _, _ in got[:3]} == {"hot-0", "hot-1", "hot-2"}
    # each task's counters are no more, however many keys there are
    assert max(r["count"] for r in hitters.summaries(frame, "u", "w", 80).groupBy(F.spark_partition_id()).count().collect()) <= 81
    # under capacity the summary is exact
    few = frame.filter("u like 'hot%' or u like 'user-1_'")
    assert {(r["u"], r["n"], r["error"]) for r in hitters.heavy_hitters(few, "u", 80, "w").collect()} == {(u, n, 0) for u, n in true.items() if u.startswith("hot") or (u.startswith("user-1") and len(u) == 7)}
    assert hitters.heavy_hitters(frame.limit(0), "u", 80).count() == 0


def test_heavy_hitters_read_their_rows_once_and_in_arrays(spark):
    """The floors of all tasks come from the same pass as the counters; arrays of keys count as their elements do."""
    rng = random.Random(11)
    rows = [([f"w{int(rng.paretovariate(0.6)) % 5000}" if rng.random() < 0.97 else None for _ in range(rng.randrange(60))] if rng.random() < 0.98 else None, rng.choice([None, 0, 1, 4])) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "ws array<string>, w long").repartition(3)
    plain = frame.select(F.explode("ws").alias("ws"), "w")
    for weight in (None, "w"):
        true = {}
        for ws, w in rows:
            for x in ws or ():
                if x is not None:
                    true[x] = true.get(x, 0) + (max(w or 1, 1) if weight else 1)
        for asked in (frame, plain):
            found = hitters.heavy_hitters(asked, "ws", 300, weight)
            got = found.collect()
            assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("MapInArrow") == 1
            assert len(got) == 300 and got == sorted(got, key=lambda r: (-r["n"], r["ws"])) and any(r["error"] for r in got)
            assert all(r["n"] - r["error"] <= true[r["ws"]] <= r["n"] for r in got)
            # nothing that isn't held has more than all floors together
            floors = hitters.summaries(asked, "ws", weight, 300).filter("ws is null").agg(F.sum("n")).first()[0]
            held = {r["ws"] for r in hitters.summaries(asked, "ws", weight, 300).collect()}
            assert floors > 0 and all(n <= floors for x, n in true.items() if x not in held)
            assert sorted(true, key=lambda x: -true[x])[:10] == [r["ws"] for r in got][:10]
            # all keys fit: exact
            assert {(r["ws"], r["n"], r["error"]) for r in hitters.heavy_hitters(asked, "ws", 6000, weight).collect()} == {(x, n, 0) for x, n in true.items()}


def test_sums_of_stretches(monkeypatch):
    """Keys in arrays are cut into stretches with their rows' weights, and null ones left out."""
    monkeypatch.setattr(hitters, "STRETCH", 3)
    rows = [(["a", "b", "a"], 2), ([], 5), (["b", None, "c", "a", "a"], 1), (None, 9), (["c"], 7)]
    for weighted in (False, True):
        want = {}
        for ws, w in rows:
            for x in ws or ():
                if x is not None:
                    want[x] = want.get(x, 0) + (w if weighted else 1)
        batch = pa.record_batch({"key": pa.array([ws for ws, _ in rows], pa.list_(pa.string()))} | ({"n": pa.array([w for _, w in rows])} if weighted else {}))
        sums = list(hitters._sums(batch, pa.string()))
        got = {}
        for some in sums:
            for r in some.to_pylist():
                got[r["key"]] = got.get(r["key"], 0) + r["n"]
        assert len(sums) == 3 and got == want


def test_a_key_s_hitters_are_given_while_rows_come(spark):
    rows = [(1, n, n * 10, f"u{n % 40 if n % 2 else 1}", None) for n in range(200)]
    frame = spark.createDataFrame(rows, "k long, n long, at long, u string, w long")
    got = walked(frame, "k", ["n"], hitters.Hitters("at", "u", "w", 20, 3, 500), "at").collect()
    assert sorted({r["at_us"] for r in got}) == [500, 1000, 1500, 1990]
    for r in got:
        true = sum(1 for _, _, at, u, _ in rows if u == r["value"] and at <= r["at_us"])
        assert r["n"] - r["error"] <= true <= r["n"]
    assert [r["value"] for r in got if r["rank"] == 1] == ["u1"] * 4
