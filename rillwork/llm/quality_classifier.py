"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are word unigrams and bigrams, as written and as shapes (letters and
digits by class, runs shortened; a word that repeats the one before is the
shape "same"), hashed into 2**18 weights.  A text is the mean of its n-grams,
so its score is one sparse dot product.  Training runs on a bounded sample in
a fixed number of shards, each a pass of FTRL-proximal updates, and averages
the shards' weights; what comes to the driver is at most 2**18 weights.

Defined cases: a null or empty text scores the bias alone; repeated rows score
alike; a null id is never held out; without labels of both kinds every score is
0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .labelled import fold, labelled_sample

BITS = 18
#: At most so many texts of each label are learned from.
SAMPLE_PER_CLASS = 6000
TRAIN_SHARDS = 8
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
FOLDS, HELD_OUT = 3, 1
#: The value of all n-grams of a channel together, and of the bias.
SCALE, BIAS = 6.0, 1.0

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def _shapes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' shapes; runs of a class count as one."""
    buf, at = T.joined(texts)
    shape = _SHAPE[buf]
    keep = np.ones(len(shape), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | T._SPACE[shape[1:]]
    where = np.flatnonzero(keep)
    s, e = T.word_spans(shape[where])
    return T.span_hashes(shape[where], s, e), np.searchsorted(s, np.searchsorted(where, at))


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each channel the hashed features and where each text's start."""
    words, at = T.words(texts, lower=False)
    shapes, shape_at = _shapes(texts)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    # a text's first word has none before it, whatever text stands before
    same[at[:-1][at[:-1] < len(words)]] = False
    shapes = np.where(same, np.uint64(1), shapes)
    mask = np.uint64((1 << BITS) - 1)
    channel = 0
    for hashes, where in ((words, at), (shapes, shape_at)):
        for n in (1, 2):
            g, g_at = (hashes, where) if n == 1 else T.grams(hashes, where, 2, whole=False)
            channel += 1
            yield (T.mixed(g + np.uint64(channel)) & mask).astype(np.int64), g_at


def _logit(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    z = np.full(len(texts), bias)
    for f, at in features(texts):
        sums = np.concatenate([[0.0], np.cumsum(weights[f])])
        z += SCALE * (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)
    return z


def ftrl(texts: list[bytes], labels: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Weights and bias after EPOCHS passes over the texts in random order."""
    rows = []
    for a, b in T.chunks(texts):
        parts = [(f, at) for f, at in features(texts[a:b])]
        for i in range(b - a):
            cols, vals = [], []
            for f, at in parts:
                own, n = np.unique(f[at[i] : at[i + 1]], return_counts=True)
                cols.append(own)
                vals.append(SCALE * n / max(n.sum(), 1))
            rows.append((np.concatenate([*cols, [1 << BITS]]), np.concatenate([*vals, [BIAS]])))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            i, x = rows[k]
            w = weight(z[i], n[i])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[k]) * x
            np.add.at(z, i, g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w)
            np.add.at(n, i, g * g)
    w = weight(z, n)
    return w[:-1], float(w[-1] * BIAS)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, float]:
    """Averaged weights of TRAIN_SHARDS learners, each on its part of the sample."""
    sample = labelled_sample(docs, labels, label, folds, held_out, per_class)

    def learn(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "text"], ignore_index=True)
        w, b = ftrl([t.encode() for t in pdf["text"]], pdf["label"].to_numpy(float), np.random.default_rng(int(pdf["shard"].iloc[0])))
        i = np.flatnonzero(w)
        return pd.DataFrame({"i": np.append(i, 1 << BITS), "w": np.append(w[i], b)})

    sharded = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(TRAIN_SHARDS)))
    means = sharded.groupBy("shard").applyInPandas(learn, "i long, w double").groupBy("i").agg((F.sum("w") / TRAIN_SHARDS).alias("w")).toPandas()
    weights = np.zeros((1 << BITS) + 1)
    weights[means["i"].to_numpy(int)] = means["w"].to_numpy(float)
    return weights[:-1], float(weights[-1])


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score) for each document, over the whole text."""
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            texts = T.blobs(batch.column(1))
            z = [_logit(texts[i:j], w, b) for i, j in T.chunks(texts)]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate([*z, np.zeros(0)]), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    weights, bias = train(docs, labels, per_class=per_class)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return score(docs, weights, bias).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
