"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic texts and one on
windows of ordinary texts.  A window is a word with its borders; its distance is
the part of its compressed length under the ordinary dictionary that the toxic
one saves, in parts of MAX_DISTANCE.  A text has the largest distance of its windows, which is turned into a
score by thresholds calibrated on labelled texts that were not trained on.

Windows are spread to SPREAD pseudo-random bytes a byte before compression: then
a match of a few letters saves more than the frame's overhead, and what isn't
matched costs the same under both dictionaries.  The ordinary dictionary is
trained on the most frequent windows of ordinary texts; the toxic one goes on
from it with the windows that toxic texts have much more often.  zstandard's own
trainer isn't used: it chooses what is frequent, not what sets a class apart.

Defined cases: a null or empty text has distance 0; repeated rows score alike; a
null id is never held out; without labels of both kinds every score is 0; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .labelled import fold, labelled_sample
from .scratch import Scratch

#: At most so many texts of each label are learned from, half of them for the thresholds.
SAMPLE_PER_CLASS = 4000
#: Bytes of a dictionary at most.
DICTIONARY_BYTES = 32 << 10
SPREAD = 4
FOLDS, HELD_OUT = 4, 2
TOXIC_SCORE = 0.3
#: A window is trained on if it is in so many texts and such a share of its class, and its rate there is so many times that in the other.
LEAST_TEXTS, LEAST_SHARE, LEAST_RATIO = 3, 0.03, 8
#: The beginnings of a window from so many bytes on are trained on too, since words change their endings.
STEM_BYTES = 5
MAX_DISTANCE = 64
#: Bytes of a window at most; longer words are cut into windows that overlap by half.
WINDOW_BYTES = 64

_CODES = np.random.default_rng(5).integers(0, 256, (256, SPREAD), dtype=np.uint8)
_PARAMS = zstandard.ZstdCompressionParameters.from_level(3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, strategy=zstandard.STRATEGY_GREEDY, min_match=6, window_log=17, search_log=9, chain_log=17, hash_log=17)


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    #: The score of each distance from 0 on.
    scores: np.ndarray


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-case bytes, starts and ends of the windows, and where each text's windows start."""
    buf, at = T.joined(texts)
    buf = T._LOWER[buf].copy()
    buf[T._SPACE[buf]] = 32
    buf = np.concatenate([np.full(1, 32, np.uint8), buf])
    s, e = T.word_spans(buf)
    step = WINDOW_BYTES // 2
    pieces = np.maximum(-(-(e - s) // step) - 1, 1)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(s, pieces) + k * step
    last = np.minimum(first + WINDOW_BYTES, np.repeat(e, pieces))
    return buf, first - 1, last + 1, np.searchsorted(first, at + 1)


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=_PARAMS)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=_PARAMS)


def distances(buf: np.ndarray, s: np.ndarray, e: np.ndarray, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> np.ndarray:
    """The distance of each window; equal windows are compressed once."""
    if not len(s):
        return np.zeros(0, np.int64)
    _, one, back = np.unique(T.span_hashes(buf, s, e), return_index=True, return_inverse=True)
    spread = _CODES[buf].tobytes()
    segments = np.stack([s[one] * SPREAD, (e - s)[one] * SPREAD], 1).astype(np.uint64).tobytes()
    sizes = []
    for c in (ordinary, toxic):
        out = c.multi_compress_to_buffer(zstandard.BufferWithSegments(spread, segments), threads=1)
        sizes.append(np.fromiter(map(len, out), np.int64, len(out)))
    return ((sizes[0] - sizes[1]) * MAX_DISTANCE // np.maximum(sizes[0], 1))[back]


def largest(texts: list[bytes], toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> np.ndarray:
    """The largest distance of each text, from 0 to MAX_DISTANCE."""
    out = np.zeros(len(texts), np.int64)
    for i, j in T.chunks(texts):
        buf, s, e, at = windows(texts[i:j])
        np.maximum.at(out, i + T.owner(at), distances(buf, s, e, toxic, ordinary))
    return np.clip(out, 0, MAX_DISTANCE)


def train_dictionary(own: Counter, n_own: int, other: Counter | None = None, n_other: int = 0) -> bytes:
    """A dictionary of the windows of a class, with ``other`` of those that set it apart.

    The weightiest come last, where zstandard finds them most cheaply.
    """
    found = [(n, w) for w, n in own.items() if n >= max(LEAST_TEXTS, LEAST_SHARE * n_own) and (other is None or n * n_other >= LEAST_RATIO * (other[w] + 0.5) * n_own)]
    kept, size = [], 0
    for _, w in sorted(found, reverse=True):
        size += len(w) * SPREAD
        if size > DICTIONARY_BYTES:
            break
        kept.append(w)
    return _CODES[np.frombuffer(b"".join(reversed(kept)), np.uint8)].tobytes()


def calibrate(found: np.ndarray, labels: np.ndarray, rate: float) -> np.ndarray:
    """Scores that never fall with the distance: the share of toxic texts, pooled where it would fall.

    ``rate`` is the share of toxic texts among all labelled ones, which weighs the balanced sample.
    """
    weight = np.where(labels == 1, rate / max(labels.sum(), 1), (1 - rate) / max((labels == 0).sum(), 1))
    pools: list[list[float]] = []
    prior = 0.5 * weight.mean()
    for d in range(MAX_DISTANCE + 1):
        at = found == d
        pools.append([weight[at & (labels == 1)].sum(), weight[at].sum(), 1])
        while len(pools) > 1 and pools[-1][0] * pools[-2][1] <= pools[-2][0] * pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.repeat([(t + prior * rate) / (w + prior) for t, w, _ in pools], [int(n) for _, _, n in pools])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Dictionaries from one half of the bounded sample, thresholds from the other half.

    What comes to the driver is window counts of the sample, and one distance for each of its texts.
    """
    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, per_class).withColumn("half", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [0, 0]
            count: list[Counter] = [Counter(), Counter()]
            for text, label in zip(T.blobs(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                buf, s, e, _ = windows([text])
                raw = buf.tobytes()
                n[label] += 1
                whole = {raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)}
                count[label].update(whole | {w[:k] for w in whole for k in range(STEM_BYTES, len(w) - 1)})
            rows = [(None, k, n[k]) for k in (0, 1)] + [(w, k, c) for k in (0, 1) for w, c in count[k].items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["w", "label", "n"])

    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.put("sample", sample)
    each = [F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)]
    counts = scratch.put("counts", sample.filter("half = 0").select("text", F.col("label").cast("int")).mapInArrow(seen, "w binary, label int, n long").groupBy("w").agg(*each))
    n = [int(x or 0) for x in counts.filter("w is null").agg(F.sum("n0"), F.sum("n1")).first()]
    count = [Counter(), Counter()]
    enough = " or ".join(f"n{k} >= {max(LEAST_TEXTS, LEAST_SHARE * n[k])}" for k in (0, 1))
    for r in counts.filter("w is not null").filter(enough).collect():
        for k in (0, 1):
            count[k][bytes(r["w"])] = int(r[f"n{k}"])
    ordinary = train_dictionary(count[0], n[0]) or _CODES[np.full(8, 32)].tobytes()
    model = Model(ordinary + train_dictionary(count[1], n[1], count[0], n[0]), ordinary, np.zeros(MAX_DISTANCE + 1))
    tested = measured(sample.filter("half = 1"), model, ["label"]).groupBy("label", "distance").count().collect()
    found = np.repeat([r["distance"] for r in tested], [r["count"] for r in tested]).astype(int)
    kinds = np.repeat([r["label"] for r in tested], [r["count"] for r in tested]).astype(int)
    if len(set(kinds.tolist())) < 2:
        return model
    share = labels.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return model._replace(scores=calibrate(found, kinds, share))


def measured(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The columns named and ``distance``, over the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model[:2])
    own = docs.select("text", *[F.col(f"`{c}`") for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, ordinary = map(compressor, shared.value)
        for batch in batches:
            found = largest(T.blobs(batch.column(0)), toxic, ordinary)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.int32())], [*columns, "distance"])

    return own.mapInArrow(run, ", ".join([*[f"`{c}` {own.schema[c].dataType.simpleString()}" for c in columns], "distance int"]))


def score_of(distance: Column, model: Model) -> Column:
    return F.element_at(F.array(*[F.lit(float(x)) for x in model.scores]), distance + 1)


def classify_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted, distance) for each document."""
    model = train(docs, labels, per_class)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    out = measured(docs, model, ["doc_id"]).withColumn("score", score_of(F.col("distance"), model))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"), "distance")


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The documents whose score is below TOXIC_SCORE, all columns as they are."""
    model = train(docs, labels, per_class)
    seen = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    scored = measured(seen, model, ["row"])
    return scored.filter(score_of(F.col("distance"), model) < TOXIC_SCORE).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
