"""Functions that DuckDB has no counterpart of, and sketches, against plain versions."""

import zlib

from rillwork.plans.queries import queries

SF = "/root/testdata/sf0.01"


def test_crc_and_sketch(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    want = {r["event_id"]: zlib.crc32(str(r["user_id"]).encode()) for r in events.select("event_id", "user_id").collect()}
    assert {r["event_id"]: r["crc"] for r in queries()["uid_crc32"](spark, SF).collect()} == want
    exact = {r["kind"]: r["senders"] for r in queries()["chat_distinct_exact"](spark, SF).collect()}
    got = {r["kind"]: r["senders"] for r in queries()["chat_distinct_hll"](spark, SF).collect()}
    assert got.keys() == exact.keys() and all(abs(got[k] - n) <= 0.05 * n for k, n in exact.items())
