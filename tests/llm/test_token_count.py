"""Token counts against the vocabulary's own library."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from rillwork.llm.token_count import Merger, count_tokens, load_merges

ODD = [None, "", " \n\t", "<|startoftext|>a<|endoftext|>", "<|endoftext|", "A<|ENDOFTEXT|>b", "don't I'LL we've", "aaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "12345 ½ ² ٣", "ΣΑΣ İstanbul ẞ ǅ", "é é Å", "漢字かな \U0001f600\U0001f468‍\U0001f469", "  　​\u0085\x1c\x1f", "\x00\x01", "ﬁ ﷺ", "'s 'S ''re", "ͅẞΣ"]


def test_equals_library(spark):
    rng = random.Random(3)
    pool = [*map(chr, range(32, 0x250)), *"'<|>ΣσςİıßǺ‍漢😀 ﻿"]
    fuzz = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(400)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate([*ODD, *fuzz])], docs.schema)).selectExpr("*", "1 as n_tokens")
    rows = docs.collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    counts = [len(e.ids) for e in library.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)]
    want = {r["doc_id"]: (len((r["text"] or "").encode()), n, n > 2048) for r, n in zip(rows, counts, strict=True)}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert {repr(texts[k])[:80]: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_every_character_and_odd_sequences():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), Merger(load_merges(path))
    rng = random.Random(2)
    texts = [f"{c}a{c}{c}b{c}" for c in map(chr, range(1, 0x33000)) if not 0xD800 <= ord(c) < 0xE000]
    texts += ["".join(chr(rng.choice((rng.randrange(1, 0x300), rng.randrange(0x300, 0x2000), rng.randrange(0x2000, 0xD800), rng.randrange(0xE000, 0x110000)))) for _ in range(6)) for _ in range(10_000)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, n, m in zip(texts, own.counts(texts).tolist(), want, strict=True) if n != m] == []


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
