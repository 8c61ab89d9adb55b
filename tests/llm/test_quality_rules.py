"""Quality rules: the base counts against brute force, the divergence by planted texts, edge cases."""

import math
import random
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from rillwork.llm import quality_rules as Q
from rillwork.llm.quality_rules import distance, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, chars int, p double"


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_base_counts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    extra = [(-1, None, "en"), (-2, "", None), (-3, " \t\n\r\x0b\x0c", "en"), (-4, "a b c d e f g h " * 3, "xx"), (-5, "x y   z", "fr"), (-6, "one\n\none\n one\none", "en"), (-7, "#*$%&|<> é 漢字 \U0001f600", "de"), (-8, "w " * 60_000, "en")]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    want = {r["doc_id"]: base(r["text"]) for r in docs.collect()}
    got = quality_rules(docs).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want[r["doc_id"]], r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_divergent_text_goes(spark):
    rng, plain = random.Random(5), "the man and a dog of the old town is in that house for it rains to day".split() * 5
    clean = [(i, " ".join(rng.sample(plain, len(plain))), "en", 1, 0.5) for i in range(40)]
    odd = (99, " ".join(f"{k * 7919 % 100000}#{k}" for k in range(120)), "en", 1, 0.5)
    short = (98, " ".join(f"{k}#" for k in range(25)), "en", 1, 0.5)
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame([*clean, odd, short], SCHEMA)).collect()}
    assert not got[99]["base_failed"] and not got[99]["kept"]
    assert got[98]["kept"] and got[98]["char_distance"] is None
    assert all(got[i]["kept"] for i, *_ in clean)


def test_distance(spark):
    p = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    row = spark.range(1).select(distance(p(1, 0), [0, 1]).alias("far"), distance(p(0.5, 0.5), [0.5, 0.5]).alias("same")).first()
    assert (row["far"], row["same"]) == (1.0, 0.0)


def test_empty_table_and_no_reference(spark):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = quality_rules(spark.createDataFrame([(None, "a b", None, 1, 0.0)], SCHEMA)).collect()
    assert row["base_failed"] and not row["kept"] and row["n_words"] == 2


def plain_shares(text):
    """Shares of characters by class and of common words."""
    left, chars = text, []
    for c in Q.CHARACTER_CLASSES.values():
        rest = re.sub(f"[{c}]", "", left)
        chars.append(len(left) - len(rest))
        left = rest
    words = WORD.findall(text)
    common = [sum(w in (c, c.capitalize()) for w in words) for c in Q.WORDS]
    bare = sum(not regex.search(r"[\p{L}\p{N}]", w) for w in words)
    share = lambda counts, n: [x / max(n, 1) for x in counts]
    return share([*chars, len(left)], len(text)), share([*common, bare, len(words) - sum(common) - bare], len(words))


def plain_distance(p, q):
    half = lambda x, y: sum(a * math.log2(a / ((a + b) / 2)) for a, b in zip(x, y, strict=True) if a > 0)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def test_kept_equals_recomputed_distances(spark):
    """Every verdict and distance of the whole table, by plain counts and means."""
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = [r for r in spark.read.parquet(path).select("doc_id", "text", "lang").collect()]
    facts = []
    for r in docs:
        text = r["text"] or ""
        p, w = plain_shares(text)
        judged = len(text) >= Q.MIN_CHARS and len(WORD.findall(text)) >= Q.MIN_JUDGED_WORDS
        facts.append((r["doc_id"], r["lang"], base(text)[-1], judged, p, w))
    references = {}
    for lang in Q.LANGUAGES:
        some = [f for f in facts if f[1] == lang and f[3] and not f[2]]
        if some:
            references[lang] = tuple([math.fsum(col) / len(some) for col in zip(*[f[k] for f in some], strict=True)] for k in (4, 5))
    assert len(references) == 4
    got = {r["doc_id"]: r for r in quality_rules(spark.read.parquet(path)).collect()}
    judged_out = 0
    for doc_id, lang, failed, judged, p, w in facts:
        r = got[doc_id]
        if not (judged and (lang is None or lang in references)):
            assert r["kept"] == (not failed) and r["char_distance"] is None
            continue
        worst, c, d = min((max(c / Q.MAX_CHAR_DISTANCE, d / Q.MAX_WORD_DISTANCE), c, d) for c, d in ((plain_distance(p, rp), plain_distance(w, rw)) for rp, rw in references.values()))
        assert (r["char_distance"], r["word_distance"]) == pytest.approx((c, d), abs=1e-6)
        if abs(worst - 1) > 1e-6:
            assert r["kept"] == (not failed and worst <= 1)
        judged_out += not failed and worst > 1
    assert judged_out > 0


def test_very_long_text(spark):
    text = "the quick word of a text is that it has no end\n" * 20_000
    row = quality_rules(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).collect()[0]
    assert row["n_words"] == 240_000 and row["n_dup_lines"] == 19_999 and row["n_repeat_words"] == 240_000 and row["base_failed"]
