"""Queries that SQL can't express, against plain walks over the same rows."""

import json
import math
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from rillwork.functions.bytes import crc32_mpeg2_of
from rillwork.operators.words import Lattice
from rillwork.plans.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events():
    rows = pq.read_table(f"{SF}/events.parquet").to_pylist()
    for r in rows:
        d = r["ts"]
        r["us"] = (d.toordinal() - 719_163) * 86_400_000_000 + ((d.hour * 60 + d.minute) * 60 + d.second) * 1_000_000 + d.microsecond
        r["k"] = json.loads(r["props"])["k"]
    return sorted(rows, key=lambda r: r["event_id"])


def by_user(events):
    out = {}
    for r in events:
        out.setdefault(r["user_id"], []).append(r)
    return out


def got(spark, name):
    return queries()[name](spark, SF).collect()


def test_bounded_gifters(spark, events):
    true = Counter()
    for r in events:
        if r["event_type"] in ("purchase", "signup"):
            true[r["user_id"]] += max(r["k"], 1)
    rows = got(spark, "gifters_bounded")
    assert 0 < len(rows) <= 64 and all(r["n"] - r["error"] <= true[r["user_id"]] <= r["n"] for r in rows)


def test_bounded_words(spark):
    texts = [t or "" for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()]
    true = Counter(w for t in texts for w in re.findall(r"[^\W_]+", t.lower()) if len(w) >= 2)
    rows = got(spark, "word_hitters_bounded")
    assert len(rows) == 200 and all(r["n"] - r["error"] <= true[r["word"]] <= r["n"] for r in rows)


def test_daily_hitters(spark, events):
    for r in got(spark, "kind_hitters_daily"):
        true = sum(1 for e in events if e["event_type"] == r["kind"] and str(e["user_id"]) == r["value"] and e["us"] <= r["at_us"])
        assert r["n"] - r["error"] <= true <= r["n"] and 1 <= r["rank"] <= 3


def test_words_by_dictionary(spark):
    han = {c: chr(0x4E00 + 37 * i) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    written = lambda t: "".join(han.get(c, c) for c in t.lower())
    docs = Counter(written(w) for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() for w in re.split("[^a-z]+", (t or "").lower()) if 2 <= len(w) <= 12)
    lattice = Lattice({w: n for w, n in docs.items() if n >= 5})
    want = Counter()
    for text in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist():
        for run in re.findall(r"[^\W_]+", re.sub(" +", "", written(text or ""))):
            cut = lattice.cut(run) if any(c in han.values() for c in run) else [run]
            want.update(w for w in cut if len(w) >= 2)
    assert {r["word"]: r["n"] for r in got(spark, "words_by_dictionary")} == want and len(want) > 50


def test_checksums_of_texts(spark):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {r["doc_id"]: None if r["text"] is None else int(crc32_mpeg2_of([r["text"].encode()])[0]) for r in rows}
    assert {r["doc_id"]: r["crc"] for r in got(spark, "text_crc32_mpeg2")} == want


def test_recording_lines(spark, events):
    lines = {r["order"]: r["line"] for r in got(spark, "recording_lines")}
    assert len(lines) == len(events)
    row = Counter()
    for e in events:
        ms, day = e["us"] // 1000, e["us"] // 86_400_000_000
        row[day] += 1
        off = f"{(ms - day * 86_400_000) / 1000:.3f}"
        line = lines[e["event_id"]]
        if e["event_type"] in ("view", "click"):
            color = int(f"0000{e['user_id'] % 256:02X}", 16)
            assert line.startswith(f'  <d p="{off},1,25,{color},{ms},0,{zlib.crc32(str(e["user_id"]).encode())},{row[day]}" user="u&amp;{e["user_id"]}">')
        elif e["event_type"] == "purchase":
            assert line == f'  <gift ts="{off}" giftname="&lt;g{e["k"]}&gt;" giftcount="{e["k"]}" price="{e["user_id"] % 9}" user="u&amp;{e["user_id"]}" uid="{e["user_id"]}" timestamp="{ms}"></gift>'


def test_keyframe_indexes(spark, events):
    want = {}
    for user, rows in by_user(events).items():
        segment, at = [], 0
        for r in [*rows, {"event_type": "signup", "event_id": None}]:
            if r["event_type"] == "signup":
                scripts = [x for x in segment if x["event_type"] == "error"]
                last, kept = -math.inf, []
                for x in segment:
                    if x["event_type"] == "view" and x["us"] - last >= 7_200_000_000:
                        last = x["us"]
                        kept.append(x)
                for n, x in enumerate(scripts):
                    want[user, x["event_id"]] = (",".join(str(y["us"]) for y in kept), ",".join(str(y["event_id"] * 100) for y in kept)) if n == 0 else (None, None)
                segment = []
            else:
                segment.append(r)
            at += 1
    rows = {(r["user_id"], r["event_id"]): (r["times"], r["places"]) for r in got(spark, "keyframe_indexes")}
    assert len(rows) == len(events) and {k: v for k, v in rows.items() if k in want} == want
    assert all(v == (None, None) for k, v in rows.items() if k not in want)


def test_replays_dropped(spark, events):
    want = {}
    for rows in by_user(events).values():
        size = len(rows)
        # ntile gives the first ones a row more
        fifth = [sum(size // 5 + (t < size % 5) for t in range(4)), size]
        last = {r["event_id"] for n, r in enumerate([r for r in rows if r["event_type"] != "signup"]) if n >= 0}
        media = [r for r in rows if r["event_type"] != "signup"]
        size = len(media)
        cut = sum(size // 5 + (t < size % 5) for t in range(4)) if size >= 5 else size
        again = [(r["event_id"] + 1_000_000_000, r["us"] // 1000 - 7_200_000, (r["event_type"], r["k"])) for r in media[cut:]]
        seen, latest, top, replays, offset = set(), {}, None, False, None
        for n, t, name in [*((r["event_id"], r["us"] // 1000, (r["event_type"], r["k"])) for r in media), *again]:
            replays |= top is not None and top - t > 2000
            top = t if top is None else max(top, t)
            gone = (name, t) in seen
            if not gone and replays:
                if offset is None and latest.get(name, t) > t:
                    offset = latest[name] - t
                gone = offset is not None and (name, t + offset) in seen
            if not gone:
                seen.add((name, t))
                latest[name] = t
            want[n] = not gone
        assert fifth and last is not None
    rows = {r["number"]: r["kept"] for r in got(spark, "replays_dropped")}
    assert rows == want and not all(want.values())


def test_assembled_segments(spark, events):
    hour = 3_600_000_000
    want = Counter()
    for user, rows in by_user(events).items():
        nxt, held, inits, came, dead, gap, needs, gave = 0, {}, {}, False, set(), None, False, False

        def settle(at):
            nonlocal nxt, gap, gave
            while True:
                for late in [i for i in held if i < nxt]:
                    del held[late]
                if nxt in dead:
                    to = nxt
                    while to + 1 in dead:
                        to += 1
                    want[user, "skip", nxt, to, "upstream"] += 1
                    nxt, gap = to + 1, None
                elif nxt in held:
                    gap, full = None, len(held) >= 12
                    if held[nxt] and not came and not full:
                        return
                    if held[nxt] and not came:
                        want[user, "skip", nxt, nxt, "pressure"] += 1
                    else:
                        due = [i for i in inits if i <= nxt]
                        if due:
                            want[user, "init", max(due), None, "a"] += 1
                        for i in due:
                            del inits[i]
                        want[user, "media", nxt, None, None] += 1
                        gave = True
                    del held[nxt]
                    nxt, gap = nxt + 1, None
                elif held:
                    if gap is None or gap[0] != nxt:
                        gap = [nxt, len(held), at]
                    count, time = gap[1] >= 3 and (gave or not needs), at - gap[2] >= 6 * hour
                    if not (len(held) >= 12 or count or time):
                        return
                    want[user, "skip", nxt, min(held) - 1, "pressure" if len(held) >= 12 else "both" if count and time else "count" if count else "time"] += 1
                    nxt, gap = min(held), None
                else:
                    return

        for place, r in enumerate(rows, 1):
            number, kind = place + r["k"] % 4, r["event_type"]
            while gap is not None and gap[2] + 6 * hour < r["us"]:
                settle(gap[2] + 6 * hour)
            if kind == "signup":
                needs, came = True, True
                inits[number] = "a"
            elif kind == "error":
                dead.add(number) if number >= nxt else None
            else:
                needs |= kind == "purchase"
                if number < nxt or number in dead:
                    want[user, "stale", number, None, None] += 1
                    continue
                if number not in held and gap is not None and number > gap[0]:
                    gap[1] += 1
                held[number] = kind == "purchase"
            settle(r["us"])
        for number in sorted(held):
            if held[number] and not came:
                want[user, "skip", number, number, "upstream"] += 1
                continue
            due = [i for i in inits if i <= number]
            if due:
                want[user, "init", max(due), None, "a"] += 1
            for i in due:
                del inits[i]
            want[user, "media", number, None, None] += 1
    assert Counter(map(tuple, got(spark, "assembled_segments"))) == want
    assert {k[4] for k in want if k[1] == "skip"} >= {"upstream", "count", "time"}
