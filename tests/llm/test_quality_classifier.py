"""Quality classifier: held-out accuracy on planted and given labels, edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rillwork.llm import quality_classifier as Q
from rillwork.llm.labelled import labelled_sample
from rillwork.llm.quality_classifier import classify_quality


def accuracy(rows, truth):
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert held
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("doc_id", "text", "1 as label", "2 as shard", "3 as score")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = classify_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    share = sum(truth.values()) / len(truth)
    assert accuracy(rows, truth) > max(share, 1 - share, 0.85)


def test_nulls_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in classify_quality(docs, none).collect()] == [0.5] * 5
    assert classify_quality(docs.limit(0), none).count() == 0


def test_the_sample_has_one_text_for_each_id(spark):
    docs = spark.createDataFrame([(2, f"t{i}") for i in range(50)] + [(3, None), (5, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, 0), (5, 0)], "doc_id long, quality int")
    got = sorted((r["doc_id"], r["label"], r["text"]) for r in labelled_sample(docs, labels, "quality", 3, 9, 5).collect())
    assert got == [(2, 1, "t0"), (3, 0, ""), (5, 0, "x")]


def plain_features(text):
    """Value of each feature by name: (channel, words or shapes)."""
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", text) if w]
    kind = lambda b: "a" if 97 <= b <= 122 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b)
    shapes = [re.sub(r"(?s)(.)\1+", r"\1", "".join(map(kind, w))) for w in words]
    shapes = ["SAME" if i and words[i] == words[i - 1] else s for i, s in enumerate(shapes)]
    out = {"bias": 1.0}
    for channel, items in enumerate((words, list(zip(words, words[1:], strict=False)), shapes, list(zip(shapes, shapes[1:], strict=False)))):
        for name, n in Counter(items).items():
            out[channel, name] = 6.0 * n / len(items)
    return out


def plain_ftrl(texts, labels, order):
    z, n = {}, {}

    def weight(f):
        return 0.0 if abs(z.get(f, 0.0)) <= 0.02 else -(z[f] - math.copysign(0.02, z[f])) / ((1.0 + math.sqrt(n[f])) / 0.5 + 0.1)

    rows = [plain_features(t) for t in texts]
    for k in order:
        w = {f: weight(f) for f in rows[k]}
        p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[f] * x for f, x in rows[k].items())))))
        for f, x in rows[k].items():
            g = (p - labels[k]) * x
            before = n.get(f, 0.0)
            z[f] = z.get(f, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / 0.5 * w[f]
            n[f] = before + g * g
    return {f: weight(f) for f in z}


def test_weights_and_scores_equal_a_plain_learner():
    rng = random.Random(4)
    vocabulary = ["good", "Good", "bad", "x1", "42", "ende", "\u00e9t\u00e9", "!!", "a-b", "zz"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 30))).encode() for _ in range(120)] + [b"", b"good good\tgood\n bad"]
    labels = np.array([float(t.count(b"good") > t.count(b"bad")) for t in texts])
    w, b = Q.ftrl(texts, labels, np.random.default_rng(7))
    again = np.random.default_rng(7)
    order = [k for _ in range(Q.EPOCHS) for k in again.permutation(len(texts))]
    plain = plain_ftrl(texts, labels, order)
    assert b == pytest.approx(plain["bias"], abs=1e-9)
    want = [sum(plain.get(f, 0.0) * x for f, x in plain_features(t).items()) for t in texts]
    assert Q._logit(texts, w, b) == pytest.approx(want, abs=1e-9)
    # the weights themselves, as often as the plain learner has them
    assert sorted(w[w != 0]) == pytest.approx(sorted(x for f, x in plain.items() if x and f != "bias"), abs=1e-9)
    # a text's score doesn't depend on the texts beside it
    assert Q._logit(texts[::-1], w, b)[::-1] == pytest.approx(want, abs=1e-9)


def test_long_text_is_scored_whole():
    long = (b"good " * 200_000) + b"tail word"
    w = np.zeros(1 << Q.BITS)
    f, _ = next(iter(Q.features([b"tail"])))
    w[f] = 5.0
    assert Q._logit([long], w, 0.0)[0] == pytest.approx(6.0 * 5.0 / 200_002)
