"""The Jaccard join against brute force over all pairs."""

import re

import pytest

from rillwork.llm.jaccard_join import jaccard_components, without_near_duplicates

SCHEMA = "doc_id long, text string"


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    home = {i: i for i in sets}

    def top(i):
        while home[i] != i:
            i = home[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                home[q] = p
    return sorted((i, len(sets[i]), top(i)) for i in sets)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_whole_table_equals_brute_force(spark, n, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in jaccard_components(docs, n, percent).collect())
    assert got == brute(rows, n, percent)
    assert len({c for _, _, c in got}) < len(got)


def test_chains_and_hot_groups(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(base[: 60 + k] + [f"x{k}"] * 2)) for k in range(1, 40)]
    rows += [(100 + k, " ".join(w if i != k else "edit" for i, w in enumerate(base))) for k in range(60)]
    rows += [(200, "Same Text"), (201, "same text"), (202, ""), (203, None), (204, " \n")]
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85).collect())
    assert got == brute(rows, 4, 85)


def test_boilerplate_that_does_not_link_makes_few_pairs(spark, monkeypatch):
    from rillwork.llm import jaccard_join

    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(f"x{k}-{i}" if i in (7 + k % 20, 30 + k % 23) else w for i, w in enumerate(base))) for k in range(400)]
    made = []
    pairs = jaccard_join._pairs

    def counted(met):
        made.append(met.count())
        return pairs(met)

    monkeypatch.setattr(jaccard_join, "_pairs", counted)
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85).collect())
    assert got == brute(rows, 4, 85)
    assert len({c for _, _, c in got}) == 400
    assert sum(made) < 10 * len(rows)


def test_parts_of_hot_tiles_lose_nothing(spark, monkeypatch):
    from rillwork.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 10)
    monkeypatch.setattr(jaccard_join, "PAIRS_PER_PART", 3)
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join([f"y{k}" if i == 3 * k else w for i, w in enumerate(base)])) for k in range(40)] + [(99, " ".join(base)), (98, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as parts", "2 as key", "3 as id")
    assert sorted(tuple(r) for r in jaccard_components(docs, 4, 85).collect()) == brute(rows, 4, 85)


def test_a_very_long_text(spark):
    long = " ".join(f"w{i * i % 7919}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "short text"), (4, long[: len(long) // 2])]
    assert sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85).collect()) == brute(rows, 4, 85)


def test_empty_table_repeated_rows_and_null_ids(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as component", "3 as row")
    assert sorted(r["component_id"] for r in jaccard_components(docs).filter("doc_id is not null").collect()) == [1, 1, 1]
    assert without_near_duplicates(docs).columns == docs.columns


def test_one_document_of_each_component_stays(spark):
    from corpus_pipeline import near_duplicates

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    kept_ids = {c for i, _, c in brute([tuple(r) for r in docs.collect()], 5, 80)}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    extra = [(-1, "a b c d e f"), (-1, "a b c d e f"), (-1, "a b c d e f"), (-2, None), (-2, None), (None, "a b c d e f"), (None, "a b c d e f"), (-3, "A b c d e f")]
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame(extra, SCHEMA)).selectExpr("*", "'x' as source")
    want = [(i, texts[i]) for i in kept_ids] + [(-3, "A b c d e f"), (-2, None), (None, "a b c d e f"), (None, "a b c d e f")]
    got = near_duplicates(spark, twice, "").select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
