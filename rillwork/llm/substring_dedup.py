"""Repeated byte strings across documents, removed wherever an earlier document starts them too.

Every text is cut where the least of hashed anchors in a window of MIN_LENGTH
bytes becomes another.  The cut depends on content alone, so equal strings of MIN_LENGTH
bytes hold the same anchor in whatever text they stand, and what lies around an
anchor (its stretch: all windows whose least anchor it is) is mostly equal too.

 1. Stretches meet by anchor. A stretch that a smaller document has is removed
    whole; each document is told which of its own these are.
 2. Only stretches that share an anchor but are not equal can hide further equal
    strings; of these the smallest document's copy alone lists its windows.
 3. Windows meet by digest. A document is told which of those that it listed a
    smaller document listed too.

Only what a document loses or has to list is told it, one digest each. Texts are
shuffled to meet that, digests once to meet each other, and what a step shuffled
is freed at its end. An anchor that many documents hold is one task's sort, which
spills; nothing holds its rows in memory.

Defined cases: a null text is empty and has no bytes; a text shorter than
MIN_LENGTH loses nothing; rows with one id are one document and lose nothing to
each other; a null id is larger than any other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .scratch import Scratch

MIN_LENGTH = 50
#: Any length up to MIN_LENGTH gives the same result: shorter anchors make fewer stretches, of which more share one by chance.
ANCHOR = 22
#: Bytes of text that are handled at a time (a longer text is handled alone).
CHUNK_BYTES = 1 << 17
LAST = 2**63 - 1


def _digest(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return T.span_hashes(buf, s, e).view(np.int64)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n, span = len(h) - width + 1, 1
    while span * 2 <= width:
        h, span = np.minimum(h[:-span], h[span:]), span * 2
    return np.minimum(h[:n], h[width - span : width - span + n])


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, and for each stretch its text, its anchor's digest, its own, and its first and last window."""
    buf, at = T.joined(texts)
    count = np.maximum(np.diff(at) - MIN_LENGTH, 0)
    if not count.any():
        none = np.zeros(0, np.int64)
        return buf, none, none, none, none, none
    owner = np.repeat(np.arange(len(texts)), count)
    window = np.arange(len(owner)) + np.repeat(at[:-1] - np.cumsum(count) + count, count)
    anchor = _least(T.window_hashes(buf, ANCHOR), MIN_LENGTH - ANCHOR + 1)[window]
    new = np.ones(len(owner), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    first, last = window[start], window[np.append(start[1:], len(owner)) - 1]
    return buf, owner[start], anchor[start].view(np.int64), _digest(buf, first, last + MIN_LENGTH), first, last


def _among(values: np.ndarray, owner: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Which values are in the list of their owner; a null list is empty."""
    known = lists.flatten().to_numpy()
    found = np.zeros(len(values), bool)
    if not len(known) or not len(values):
        return found
    whose = np.repeat(np.arange(len(lists)), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())
    # most values are in no list: 16 bits tell so for nearly all of them
    some = np.zeros(1 << 16, bool)
    some[known & 0xFFFF] = True
    may = np.flatnonzero(some[values & 0xFFFF])
    kinds, rank = np.unique(known, return_inverse=True)
    place = np.minimum(np.searchsorted(kinds, values[may]), len(kinds) - 1)
    same = kinds[place] == values[may]
    may, place = may[same], place[same]
    found[may] = np.isin(owner[may] * len(kinds) + place, whose * len(kinds) + rank)
    return found


def _bare(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows and their texts, the second column, few enough for a processor's cache."""
    for batch in batches:
        texts = T.blobs(batch.column(1))
        for i, j in T.chunks(texts, CHUNK_BYTES):
            yield batch.slice(i, j - i), texts[i:j]


def _listed(docs: DataFrame) -> DataFrame:
    """(anchor, stretch, doc) for each stretch of each document, a repeated one mostly once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _chunks(batches):
            _, owner, anchor, own, _, _ = stretches(texts)
            doc = rows.column(0).to_numpy()[owner]
            order = np.lexsort((doc, own))
            keep = np.ones(len(order), bool)
            keep[1:] = (own[order[1:]] != own[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
            one = order[keep]
            yield pa.RecordBatch.from_arrays([pa.array(x[one]) for x in (anchor, own, doc)], ["anchor", "stretch", "doc"])

    return _bare(docs).mapInArrow(run, "anchor long, stretch long, doc long")


def _windows(docs: DataFrame) -> DataFrame:
    """(doc, string) for rows (doc, text, open): the windows of the open stretches, a repeated one mostly once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _chunks(batches):
            buf, owner, _, own, first, last = stretches(texts)
            one = np.flatnonzero(_among(own, owner, rows.column(2)))
            if not len(one):
                continue
            count = (last - first + 1)[one]
            at = np.repeat(first[one] - np.cumsum(count) + count, count) + np.arange(count.sum())
            h = T.window_hashes(buf, MIN_LENGTH)[at].view(np.int64)
            doc = np.repeat(rows.column(0).to_numpy()[owner[one]], count)
            order = np.lexsort((h, doc))
            keep = np.ones(len(order), bool)
            keep[1:] = (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(x[order[keep]]) for x in (doc, h)], ["doc", "string"])

    return docs.mapInArrow(run, "doc long, string long")


def _told(docs: DataFrame) -> DataFrame:
    """(doc, string, lost): stretches that a document loses to a smaller one, and those it leads whose windows it must list."""
    rows = _listed(docs).repartition("anchor").sortWithinPartitions("anchor", "stretch")
    same, near = Window.partitionBy("anchor", "stretch"), Window.partitionBy("anchor")
    several = (F.min("stretch").over(near) < F.max("stretch").over(near)) & (F.min("doc").over(near) < F.max("doc").over(near))
    rows = rows.select("doc", F.col("stretch").alias("string"), (F.col("doc") > F.min("doc").over(same)).alias("lost"), several.alias("several"))
    return rows.filter("lost or several").select("doc", "string", "lost")


def _met_earlier(strings: DataFrame) -> DataFrame:
    """The rows (doc, string) whose string a smaller document has too."""
    return strings.withColumn("first", F.min("doc").over(Window.partitionBy("string"))).filter("first < doc").select("doc", "string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each document; ``kept`` is the bytes left."""
    scratch = Scratch(docs.sparkSession, "substrings")
    told = scratch.put("told", _told(docs))
    wanted = told.filter("not lost").groupBy("doc").agg(F.collect_set("string").alias("open"))
    windows = scratch.put("windows", _windows(_bare(docs).join(wanted, "doc").select("doc", "text", "open")))
    met = scratch.put("met", _met_earlier(windows))
    scratch.drop("windows")
    struck = told.filter("lost").select("doc", "string").unionByName(met).groupBy("doc").agg(F.collect_set("string").alias("struck"))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text").join(struck, "doc", "left").select("doc_id", "text", "struck")

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _chunks(batches):
            buf, owner, _, own, first, last = stretches(texts)
            edge = np.zeros(len(buf) + 1, np.int64)
            struck = rows.column(2)
            if struck.null_count < len(struck):
                lost = _among(own, owner, struck)
                np.add.at(edge, first[lost], 1)
                np.add.at(edge, last[lost] + MIN_LENGTH, -1)
                # other stretches may have some windows of a smaller document
                count = np.where(lost, 0, last - first + 1)
                at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                at = at[_among(T.window_hashes(buf, MIN_LENGTH)[at].view(np.int64), np.repeat(owner, count), struck)]
                edge[at] += 1
                edge[at + MIN_LENGTH] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            out, end = [], 0
            for raw in texts:
                start, end = end, end + len(raw)
                kept = buf[start:end][~gone[start:end]].tobytes()
                out.append((len(raw), len(raw) - len(kept), int(begin[start:end].sum()), hashlib.sha256(kept).hexdigest(), kept))
                end += 1  # the line feed between texts
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
