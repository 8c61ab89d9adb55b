"""File sources against plain readers of the same files."""

import os
import xml.etree.ElementTree as ET
import zlib

import pytest
from pyspark.sql import functions as F

from rillwork.sources import logs, recordings


@pytest.fixture
def folder(tmp_path):
    days = {"app.log.2024-01-03": ["c1 x", "c2 need", ""], "app.log.2024-01-02": [f"b{i} {'need' if i % 3 == 0 else 'not'} " + "y" * 400 for i in range(3000)], "app.log.2024-01-01": ["a1 need\r", "a2"], "app.log.2024-01-99": ["odd need"], "app.log": ["now need"], "other.log.2024-01-03": ["no need"]}
    for name, lines in days.items():
        (tmp_path / name).write_bytes("".join(x + "\n" for x in lines).encode())
        os.utime(tmp_path / name, (1_704_412_800, 1_704_412_800))  # 2024-01-05
    return tmp_path, {n: [x.rstrip("\r") for x in v] for n, v in days.items() if n.startswith("app")}


def newest_first(days):
    day = lambda n: n[8:] if n[8:] in ("2024-01-01", "2024-01-02", "2024-01-03") else "2024-01-05"
    for name in sorted(sorted(days), key=day, reverse=True):
        for n, text in enumerate(days[name], 1):
            yield day(name), name, n, text


def test_log_pages(spark, folder):
    path, days = folder
    files = logs.log_files(spark, str(path), "app.log")
    assert {r["file"] for r in files.collect()} == set(days)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")  # several blocks for the large file
    try:
        lines = logs.log_lines(files)
        want = list(newest_first(days))
        order = [F.desc("day"), "file", "line_no"]
        assert [(str(r["day"]), r["file"], r["line_no"], r["text"]) for r in lines.orderBy(*order).collect()] == want
        for offset, limit, needle in ((0, 2, None), (2, 10, "need"), (1000, 5, "need"), (1003, 5, "need"), (0, 10_000, None), (5, 3, "absent")):
            fits = [w for w in want if needle is None or needle in w[3]]
            page = logs.log_page(lines, offset, limit, needle).orderBy(*order).collect()
            assert [(str(r["day"]), r["file"], r["line_no"], r["text"]) for r in page] == fits[offset : offset + limit]
            assert {r["has_more"] for r in page} == ({len(fits) > offset + limit} if page else set())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_other_days_aren_t_opened(spark, folder):
    path, _ = folder
    asked = logs.log_files(spark, str(path), "app.log", "2024-01-01", "2024-01-03")
    assert sorted(r["file"] for r in asked.collect()) == ["app.log.2024-01-01", "app.log.2024-01-02", "app.log.2024-01-03"]
    one = logs.log_files(spark, str(path), "app.log", last="2024-01-02", file="app.log.2024-01-01")
    lines = logs.log_lines(one)
    assert [os.path.basename(f) for f in lines.inputFiles()] == ["app.log.2024-01-01"]
    assert [r["text"] for r in lines.orderBy("line_no").collect()] == ["a1 need", "a2"]
    assert logs.log_lines(one.limit(0)).count() == 0


MESSAGES = "segment int, at long, kind string, uid string, user string, content string, color string, meta string"
ROWS = [
    (1, 1_700_000_000_500, "chat", "u1", 'A & "B"', "hi <b> 'x'", "#ff0000", None),
    (1, 1_699_999_999_000, "chat", None, None, None, "nope", None),
    (1, 1_700_000_001_007, "gift", "u2", "C", "", None, '{"gift_name": "Rose & co", "gift_count": 3, "price": 5}'),
    (1, 1_700_000_002_000, "super_chat", "u3", "D", "  thanks & bye ", "00ff00", '{"price": 30, "time": 60}'),
    (1, 1_700_000_003_000, "system", "u4", "", "note", None, "not json"),
    (2, 1_700_000_000_000, "gift", "u5", "E", None, None, '{"gift_count": -1}'),
    (2, 1_700_000_000_001, None, "u6", "主播", "加油 🤣", "ABCDEF", "{}"),
]
START = 1_700_000_000_000


def lines_of(spark):
    rows = spark.createDataFrame(ROWS, MESSAGES).withColumn("row", F.expr("row_number() over (partition by segment order by at, uid)"))
    c = F.col
    line = recordings.xml_line(c("at") - START, c("kind"), c("at"), c("uid"), c("user"), c("content"), c("color"), c("meta"), c("row"))
    return rows.select("segment", F.col("at").alias("order"), line.alias("line"))


def test_lines_of_recordings(spark):
    got = [r["line"] for r in lines_of(spark).orderBy("segment", "order").collect()]
    crc = lambda x: zlib.crc32(x.encode())
    assert got == [
        f'  <d p="0.000,1,25,16777215,1699999999000,0,{crc("")},1" user=""></d>',
        f'  <d p="0.500,1,25,16711680,1700000000500,0,{crc("u1")},2" user="A &amp; &quot;B&quot;">hi &lt;b&gt; &apos;x&apos;</d>',
        '  <gift ts="1.007" giftname="Rose &amp; co" giftcount="3" price="5" user="C" uid="u2" timestamp="1700000001007"></gift>',
        '  <sc ts="2.000" user="D" uid="u3" price="30" time="60" timestamp="1700000002000">thanks &amp; bye</sc>',
        f'  <d p="3.000,4,25,16777215,1700000003000,0,{crc("u4")},5" user="">note</d>',
        '  <gift ts="0.000" giftname="" giftcount="0" price="0" user="E" uid="u5" timestamp="1700000000000"></gift>',
        f'  <d p="0.001,1,25,11259375,1700000000001,0,{crc("u6")},2" user="主播">加油 🤣</d>',
    ]


def test_recordings_are_read_back(spark, tmp_path):
    recordings.write_recordings(lines_of(spark), f"file://{tmp_path}/out")
    files = sorted((tmp_path / "out").glob("segment=*/*.txt"))
    assert len(files) == 2
    for f in files:
        root = ET.fromstring(f.read_text())
        assert root.tag == "i" and len(root) == sum(r[0] == int(f.parent.name[-1]) for r in ROWS)
    got = recordings.read_recordings(spark, f"file://{tmp_path}/out").orderBy("timestamp_ms").collect()
    said = [(r["kind"], r["time"], r["mode"], r["timestamp_ms"], r["row_id"], r["username"], r["content"]) for r in got]
    assert sorted(said, key=str) == sorted([
        ("chat", 0.0, 1, 1_699_999_999_000, "1", None, ""), ("chat", 0.5, 1, 1_700_000_000_500, "2", 'A & "B"', "hi <b> 'x'"), ("gift", 1.007, 1, 1_700_000_001_007, "gift-1", "C", "Rose & co x3"),
        ("super_chat", 2.0, 5, 1_700_000_002_000, "sc-1", "D", "thanks & bye"), ("chat", 3.0, 4, 1_700_000_003_000, "5", None, "note"), ("gift", 0.0, 1, 1_700_000_000_000, "gift-1", "E", "Gift x0"), ("chat", 0.001, 1, 1_700_000_000_001, "2", "主播", "加油 🤣"),
    ], key=str)


def test_recordings_of_many_lines_are_whole_files(spark, tmp_path):
    """One file for each segment, also if Spark joins fewer partitions of the lines than of their heads and feet."""
    setting = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    rows = spark.range(0, 6000, 1, 4).selectExpr("int(id % 6) as segment", "1700000000000 + id as at", "if(id % 5 = 0, 'gift', 'chat') as kind", "string(id % 97) as uid", "string(id) as text")
    rows = rows.withColumn("row", F.expr("row_number() over (partition by segment order by at)"))
    c = F.col
    line = recordings.xml_line(c("at") - START, c("kind"), c("at"), c("uid"), c("uid"), c("text"), F.lit(None).cast("string"), F.lit("{}"), c("row"))
    try:
        spark.conf.set(setting, "4k")
        recordings.write_recordings(rows.select("segment", c("at").alias("order"), line.alias("line")), f"file://{tmp_path}/out")
    finally:
        spark.conf.unset(setting)
    files = sorted((tmp_path / "out").glob("segment=*/*.txt"))
    assert [f.parent.name for f in files] == [f"segment={s}" for s in range(6)]
    for f in files:
        stamps = [int(x.get("timestamp") or x.get("p").split(",")[4]) - START for x in ET.fromstring(f.read_text())]
        assert stamps == list(range(int(f.parent.name[-1]), 6000, 6))
    got = recordings.read_recordings(spark, f"file://{tmp_path}/out").select("kind", "timestamp_ms", "row_id").collect()
    assert sorted(tuple(r) for r in got) == sorted(("gift", START + i, f"gift-{i // 30 + 1}") if i % 5 == 0 else ("chat", START + i, str(i // 6 + 1)) for i in range(6000))


def test_older_and_broken_recordings(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><i><d p="1.5,4,25,1,1700000000,0,ab,7 user=Old Name">x</d><d p="1,2,3">short</d><d p="t,1,25,1,1,0,a,8">no time</d><gift giftname="no time"></gift><sc ts="9" uid="q" timestamp="">pay</sc></i>')
    got = recordings.read_recordings(spark, f"file://{tmp_path}").collect()
    assert sorted((r["kind"], r["time"], r["timestamp_ms"], r["row_id"], r["username"], r["user_hash"], r["content"]) for r in got) == [("chat", 1.5, 1_700_000_000_000, "7", "Old Name", "ab", "x"), ("super_chat", 9.0, None, "sc-1", None, "q", "pay")]
