"""Alignment of two tokenizers against a plain version over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from rillwork.llm import token_alignment as A
from rillwork.llm.queries import op11_token_alignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizers():
    return A.Tokenizers(public_tokenizers.path(A.VOCABULARY_A), public_tokenizers.path(A.VOCABULARY_B))


def plain_groups(t, text):
    """Lists of ids of each group, over the whole text; none if a side's bytes differ."""
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(t.bytes_a[i] for i in a) != raw or b"".join(t.bytes_b[i] for i in b) != raw:
        return []
    ends = lambda ids, of: [sum(len(of[i]) for i in ids[: k + 1]) for k in range(len(ids))] if len(ids) < 500 else np.cumsum([len(of[i]) for i in ids]).tolist()
    ea, eb = ends(a, t.bytes_a), ends(b, t.bytes_b)
    out, i, j = [], 0, 0
    for cut in sorted(set(ea) & set(eb)):
        p, q = ea.index(cut, i) + 1, eb.index(cut, j) + 1
        out.append((a[i:p], b[j:q]))
        i, j = p, q
    return out


def plain(t, docs):
    all_ = [plain_groups(t, text) if text else [] for _, text in docs]
    links = [Counter((a, b) for x, y in groups for a in x for b in y) for groups in all_]
    count = Counter(p for found in links for p in found)
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    rows = []
    for (doc, _), groups, found in zip(docs, all_, links, strict=True):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(n for p, n in found.items() if count[p] == most[p[0]])
        rows.append((doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(found.values()), best, sum(n * count[p] for p, n in found.items()), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return rows


def odd_texts():
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", " ", " ", "　", "▁", "'s", "the", "Wort", "été", "中文", "👍🏽", "\x00", "1234", "...", "<|endoftext|>", "</s>", "<0x41>", "́", "ﬁ", "\x85", "x" * 30]
    return ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(400)]


def key(row):
    return str(row)


COLUMNS = ["doc_id", *A._SUMS, "n_best", "count_sum", "groups_sha256"]


def collected(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=key)


def test_odd_texts_nulls_ties_and_repeats(spark, tokenizers):
    texts = [None, "", " ", "  ", " a", "a ", "a  b", "don't", "a▁b c", *odd_texts(), "word " * 3, "word " * 3]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (9, texts[9])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as pair", "2 as n", "3 as n_a")
    want = sorted(plain(tokenizers, docs), key=key)
    assert collected(A.align(frame.repartition(3))) == want
    # by the join
    assert collected(A.align(frame, pairs=0)) == want
    assert A.align(frame.limit(0)).count() == 0
    assert dict(A.align(frame.limit(0)).dtypes) == dict.fromkeys(COLUMNS, "bigint") | {"groups_sha256": "string"}


def test_long_texts(spark, tokenizers):
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "Bravo,", "straße", "x" * 700]) for _ in range(20_000))
    docs = [(1, long), (2, "z" * 30_000), (3, long[:500])]
    got = collected(A.align(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == sorted(plain(tokenizers, docs), key=key)


def test_query_on_whole_table(spark, tokenizers):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = collected(op11_token_alignment(spark, SF))
    assert got == sorted(plain(tokenizers, docs), key=key)
    assert sum(r[4] for r in got) > 10_000


def test_forgetting_changes_nothing(tokenizers, monkeypatch):
    texts = [t for t in odd_texts() if t]
    want, digests, _ = A.Aligner(tokenizers).rows(texts)
    monkeypatch.setattr(A, "REMEMBERED", 20)
    small = A.Aligner(tokenizers)
    got = [small.rows(texts[i : i + 7]) for i in range(0, len(texts), 7)]
    assert np.array_equal(np.concatenate([g[0] for g in got]), want)
    assert sum((g[1] for g in got), []) == digests


def test_rank_and_select():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 1000):
        ends = np.flatnonzero(rng.random(n) < 0.4) + 1
        words = A.packed(ends, n)
        assert np.array_equal(A.select(words), ends - 1)
        places = np.arange(n)
        assert np.array_equal(A.rank(words, places), np.searchsorted(ends - 1, places, "right"))
