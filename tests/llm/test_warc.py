"""Archives and their index against plain versions of the same."""

import gzip
import hashlib
import io
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rillwork.llm import warc
from rillwork.llm.scratch import Scratch

SCHEMA = "page_id long, url string, html string"
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def plain(rows):
    """What each row must give, whichever of equal rows is the response."""
    first, out, taken = {}, [], set()
    for page, _, html in rows:
        h = html or ""
        if len(h.encode()) >= 100:
            first[h] = min(first.get(h, (True, 0)), (page is None, page or 0))
    for page, _, html in rows:
        h = html or ""
        f = first.get(h)
        revisit = f is not None and ((page is None, page or 0) != f or h in taken)
        if f is not None and (page is None, page or 0) == f:
            taken.add(h)
        out.append((page, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if revisit else "response", (None if f[0] else f[1]) if revisit else None))
    return sorted(out, key=str)


def cases():
    rng = random.Random(2)
    big, hot = "é" * 60, "<p>" + "hot " * 50
    rows = [(1, "http://a.example/x", None), (2, "http://a.example/x", ""), (3, None, "short"), (4, "", "short"), (5, "no url", big), (None, "http://b.example", big), (9, "http://B.example:80/#f", big)]
    rows += [(7, "http://a.example/x", hot)] * 2 + [(7, "http://a.example/y", hot), (8, "u\r\nWARC-Type: x", hot), (-3, "http://a.example:8080?q", hot + "\r\n\r\n")]
    rows += [(None, None, "only nulls " * 20)] * 2
    rows += [(100 + i, f"http://host{rng.randrange(9)}.example/p{rng.randrange(40)}", rng.choice([hot, big, "x" * rng.randrange(300)])) for i in range(300)]
    rows += [(1000 + i, "https://one.example/hot", hot) for i in range(200)]
    return [*rows, (5000, "http://long.example/", "long text " * 300_000)]


@pytest.mark.parametrize("block_lines", [7, 3000])
def test_round_trip(spark, block_lines):
    rows = cases()
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as digest", "2 as same", "3 as copy", "4 as key", "5 as first")
    got = warc.archive_and_read(pages.repartition(5), block_lines)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == plain(rows)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_look_up_finds_just_the_key(spark):
    scratch = Scratch(spark, "warc-test")
    archives, index = f"{scratch.root}/a", f"{scratch.root}/i"
    rows = cases()
    pages = spark.createDataFrame(rows, SCHEMA)
    entries = scratch.put("entries", warc.write_archives(pages, archives))
    shards = scratch.put("shards", warc.write_index(entries, index, 5))
    assert shards.count() > 1
    keys = ["example,one)/hot", "example,host3)/p7", "example,nowhere)/", "", "zzz", None]
    found = warc.look_up(spark.createDataFrame([(k,) for k in keys], "key string"), shards, index)
    want = entries.filter(F.col("key").isin("example,one)/hot", "example,host3)/p7", ""))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    one = warc.read_records(found.filter("key = 'example,one)/hot'"), archives).collect()
    assert len(one) == 200 and {r["url"] for r in one} == {"https://one.example/hot"}
    assert {r["record_type"] for r in one} == {"revisit"} and {bytes(r["payload"]) for r in one} == {b""}
    # every archive is a plain gzip file of records
    names = {r["file"] for r in entries.select("file").distinct().collect()}
    text = b"".join(gzip.open(io.BytesIO((Path(archives.removeprefix("file://")) / n).read_bytes())).read() for n in names)
    assert text.count(b"WARC/1.1\r\nWARC-Type: re") == len(rows) and text.count(b"WARC-Type: warcinfo") == len(names)


def test_keys(spark):
    urls = ["https://www.Example.com:443/a?b#c", "http://u:p@x.org:81", "http://x.org?q=1", "mailto:a@b", None, "HTTP://X.org/A\nB"]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(warc.capture_key(F.col("u"))).collect()]
    assert got == ["com,example,www)/a?b", "org,x:81)/", "org,x)/?q=1", "mailto:a@b", "", "org,x)/A\nB"]


def test_damage_is_found():
    good = warc.record("1", "u", b"payload", hashlib.sha256(b"payload").hexdigest(), 1, None, False, "1970-01-01T00:00:00Z")
    assert warc.parsed(good)[1] == "1"
    with pytest.raises(ValueError, match="payload"):
        warc.parsed(warc.record("1", "u", b"payload", "0" * 64, 1, None, False, "1970-01-01T00:00:00Z"))
