"""URLs against the standard library, and small operators of the store by hand."""

from urllib.parse import parse_qsl, urlencode, urljoin

from pyspark.sql import functions as F

from rillwork.functions import urls
from rillwork.operators import filters, store


def test_resolving(spark):
    bases = ["http://a.example/b/c/d.m3u8?q=1#f", "https://a.example", "http://a.example/x/"]
    rest = ["g", "./g", "g/", "/g", "//h.example/k", "?y=2", "g?y", "#s", "g#s", "", "..", "../", "../g", "../../g", "../../../g", "./", "/./g", "/../g", "g/./h", "g/../h", "http://x.example/z", "g;x=1/../y", "/a//b/../c"]
    rows = [(b, r) for b in bases for r in rest]
    got = {(r["b"], r["r"]): r["u"] for r in spark.createDataFrame(rows, "b string, r string").withColumn("u", urls.resolved_url(F.col("b"), F.col("r"))).collect()}
    for b, r in rows:
        want = urljoin(b, r)
        # the path of a host is never empty here, and an empty reference drops the fragment
        want = b.split("#")[0] if r == "" else want
        head = want.split("://", 1)
        if "/" not in head[1].split("?")[0].split("#")[0]:
            want = want.replace(head[1].split("?")[0].split("#")[0], head[1].split("?")[0].split("#")[0] + "/", 1)
        assert got[b, r] == want, (b, r)
    assert spark.range(1).select(urls.resolved_url(F.lit(None).cast("string"), F.lit("g"))).first()[0] is None


def test_identity_and_inheritance(spark):
    rows = ["http://a/b?a-b=1&a=1&t=0", "http://a/b?a=1&c=2#f", "http://a/b?t=1#f", "http://a/b#f", "http://a/b?x=%20y&t=&x=a", "http://a/b?bad=%zz&t=1", None]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "i int, u string").orderBy("i").select(urls.identity_url(F.col("u"), ("t",))).collect()]
    assert got == ["http://a/b?a=1&a-b=1", "http://a/b?a=1&c=2#f", "http://a/b", "http://a/b", "http://a/b?x=+y&x=a", "http://a/b?bad=%25zz", None]
    cases = [("http://a/b", "k=1&l=2&k=3"), ("http://a/b?k=0#f", "k=1&l=a+b%26"), ("http://a/b?k=0", ""), ("http://a/b?k=0", None), ("http://a/b?k=0", "k=5")]
    for url, parent in cases:
        have = dict(parse_qsl(url.split("?")[1].split("#")[0] if "?" in url else "", keep_blank_values=True))
        new = {}
        for k, v in parse_qsl(parent or "", keep_blank_values=True):
            if k not in have:
                new.setdefault(k, v)
        base, _, fragment = url.partition("#")
        want = url if not new else base + ("&" if "?" in base else "?") + urlencode(new) + (f"#{fragment}" if fragment else "")
        assert spark.range(1).select(urls.inherited_query(F.lit(url), F.lit(parent).cast("string"))).first()[0] == want


def test_outbox_twice_and_nulls(spark):
    outbox = spark.createDataFrame([(1, 0, None, None), (2, 3, "x", None), (3, None, None, 9), (4, 1, "y", None)], "id long, attempts int, last_error string, delivered_at long").withColumn("tried_", F.lit("mine"))
    results = spark.createDataFrame([(1, None), (2, "again"), (2, "again"), (3, None), (4, "bad"), (4, None), (7, None)], "id long, error string")
    once = store.after_delivery(outbox, results, "id", F.lit(50).cast("long"))
    rows = lambda f: sorted(map(tuple, f.collect()))
    assert rows(once) == [(1, 1, None, 50, "mine"), (2, 4, "again", None, "mine"), (3, None, None, 9, "mine"), (4, 2, None, 50, "mine")]
    # delivered entries stay as they are
    again = store.after_delivery(once, results.filter("id <> 2"), "id", F.lit(60).cast("long"))
    assert rows(again) == rows(once)
    assert [r["id"] for r in store.undelivered(once, "id", "delivered_at", 5).collect()] == [2]
    assert store.after_delivery(outbox.limit(0), results, "id", F.lit(1).cast("long")).count() == 0


def test_layers_pages_and_patterns(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, team string")
    own, team = spark.createDataFrame([(1, None, 3), (2, "mine", None)], "id long, name string, n int"), spark.createDataFrame([("a", "ours", 1), ("a", "zzz", 9), ("b", "theirs", 2)], "team string, name string, n int")
    got = store.layered([(own, "id"), (team, "team")], rows, {"name": None, "n": 2})
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "a", "ours", 3), (2, "b", "mine", 2), (3, None, None, 2)]
    assert store.page_with_total(rows.withColumn("total", F.lit(8)), [F.col("id")], 2, 1).columns == ["id", "team", "total", "total_"]
    assert [tuple(r) for r in store.page_with_total(rows, [F.col("id")], 2, 1).select("id", "total").collect()] == [(2, 3), (3, 3)]
    bad = rows.select(filters.regex_matches(F.col("team"), "(", exclude=True).alias("x"), filters.regex_matches(F.col("team"), "A").alias("y"))
    assert [tuple(r) for r in bad.collect()] == [(False, True), (False, False), (False, False)]
    line = store.timeline(spark.createDataFrame([(1, 1, 5, 9, None), (1, 2, 10, None, "r"), (1, 3, 11, 30, "s"), (None, 1, None, None, None)], "k long, n long, a long, b long, why string"), "k", "n", "a", "b", "why")
    assert sorted(map(tuple, line.collect()), key=str) == [(1, 3, 5, 30, 19, "r"), (None, 1, None, None, None, None)]
