"""Benchmark decontamination by greedy string tiling.

Texts are words in lower case, with ASCII punctuation as white space.  A document
and a test item meet where they share a seed of MIN_MATCH words, found by running
Karp-Rabin hashes.  Then the longest match of words that are in no tile yet
becomes a tile, again and again, until none of MIN_MATCH words is left.  Tiles
may lie in any order in the document, so reordered passages are caught.  The
part of an item's words that tiles cover is its coverage; a document is
contaminated if some item's coverage reaches the threshold.

The items are dealt into blocks of bounded size, and each block is broadcast in
turn, so a benchmark of any size is compared with all documents.

Defined cases: a null or empty text has no words and is clean; an item of fewer
than MIN_MATCH words is too short to be told from chance and matches nothing;
each row of documents gives one row, whatever its id, and is judged by its own
text; of items with equal coverage the smallest id is named, one without an id
(which can't be named) last; an empty table on either side gives clean documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import Scratch

MIN_MATCH = 5
THRESHOLD = 0.5
#: Pairs of a place in a text and one in an item that are looked at together.
PAIRS_AT_ONCE = 2 << 20
#: Bytes of item texts in a block, on average.
BLOCK_BYTES = 8 << 20

_PUNCTUATION = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


class Block(NamedTuple):
    """Items of a block: their ids (or null), words one after the other, where each starts; seeds in order of hash with their places."""

    ids: list[int | None]
    words: np.ndarray
    at: np.ndarray
    seeds: np.ndarray
    places: np.ndarray


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return T.words([t.translate(_PUNCTUATION) for t in texts])


def block_of(ids: list[int | None], texts: list[bytes]) -> Block:
    words, at = tokens(texts)
    seeds, seed_at = T.grams(words, at, MIN_MATCH, whole=False)
    places = np.arange(len(seeds)) - np.repeat(seed_at[:-1] - at[:-1], np.diff(seed_at))
    order = np.argsort(seeds, kind="stable")
    return Block(ids, words, at, seeds[order], places[order])


class Runs(NamedTuple):
    """Maximal runs of shared seeds: the text, the item, place in the item less place in the text, first place in the item, seeds."""

    text: np.ndarray
    item: np.ndarray
    shift: np.ndarray
    start: np.ndarray
    length: np.ndarray

    def at(self, where: np.ndarray | slice) -> Runs:
        return Runs(*[x[where] for x in self])


def joined_runs(parts: list[Runs]) -> Runs:
    """All runs in order, those that continue each other as one."""
    all_ = Runs(*[np.concatenate(x) for x in zip(*parts, strict=True)])
    all_ = all_.at(np.lexsort((all_.start, all_.shift, all_.item, all_.text)))
    new = np.ones(len(all_.text), bool)
    for x in all_[:3]:
        new[1:] &= x[1:] == x[:-1]
    new[1:] = ~(new[1:] & (all_.start[1:] == all_.start[:-1] + all_.length[:-1]))
    first = np.flatnonzero(new)
    return all_.at(first)._replace(length=np.add.reduceat(all_.length, first) if len(first) else all_.length)


def tiles(n_item: int, n_doc: int, runs: Runs) -> int:
    """How many words of the item greedy tiling covers, given the runs of shared seeds of one text and one item."""
    length = runs.length + MIN_MATCH - 1
    heap = [(-n, a, b) for n, a, b in zip(length.tolist(), runs.start.tolist(), (runs.start - runs.shift).tolist(), strict=True)]
    heapq.heapify(heap)
    item_done, doc_done = np.zeros(n_item, bool), np.zeros(n_doc, bool)
    covered = 0
    while heap and covered < n_item:
        n, a, b = heapq.heappop(heap)
        n = -n
        taken = item_done[a : a + n] | doc_done[b : b + n]
        if not taken.any():
            item_done[a : a + n] = doc_done[b : b + n] = True
            covered += n
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= MIN_MATCH:
                heapq.heappush(heap, (s - e, a + s, b + s))
    return covered


def shared_runs(seeds: np.ndarray, seed_at: np.ndarray, block: Block) -> Runs:
    """The runs of seeds that texts share with items.

    At most about PAIRS_AT_ONCE pairs of places are held at a time.  Once an item
    is found whole in a text, its further runs there are left out: its coverage
    is 1 already.  So a text and an item of one word repeated stay cheap.
    """
    none = np.zeros(0, np.int64)
    runs, first, keys, places = Runs(*[none] * 5), 0, block.seeds, block.places
    text_of, size = T.owner(seed_at), np.diff(block.at)
    while first < len(seeds):
        lo, hi = np.searchsorted(keys, seeds[first:], "left"), np.searchsorted(keys, seeds[first:], "right")
        many = hi - lo
        end = max(1, int(np.searchsorted(np.cumsum(many), PAIRS_AT_ONCE, "right")))
        hit = np.flatnonzero(many[:end])
        many = many[hit]
        k = first + np.repeat(hit, many)
        place = places[np.repeat(lo[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        item = np.searchsorted(block.at, place, "right") - 1
        i, j = place - block.at[item], k - seed_at[text_of[k]]
        runs = joined_runs([runs, Runs(text_of[k], item, i - j, i, np.ones(len(i), np.int64))])
        first += end
        if first < len(seeds) and text_of[first] == text_of[-1]:
            # only one text is left
            whole = np.unique(runs.item[(runs.text == text_of[-1]) & (runs.length + MIN_MATCH - 1 >= size[runs.item])])
            if len(whole):
                still = ~np.isin(np.searchsorted(block.at, places, "right") - 1, whole)
                keys, places = keys[still], places[still]
    return runs


def coverages(texts: list[bytes], block: Block, threshold: float) -> Iterator[tuple[int, int | None, float]]:
    """(text, item id, coverage) of what reaches the threshold."""
    if not len(block.seeds):
        return
    size = np.diff(block.at)
    for x, y in T.chunks(texts):
        words, at = tokens(texts[x:y])
        seeds, seed_at = T.grams(words, at, MIN_MATCH, whole=False)
        runs = shared_runs(seeds, seed_at, block)
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(runs.text) != 0) | (np.diff(runs.item) != 0), [True]])) if len(runs.text) else np.zeros(1, int)
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            d, q = int(runs.text[s]), int(runs.item[s])
            own = runs.at(slice(s, e))
            # what the runs cover, overlaps counted once, bounds the tiles from above
            most = np.zeros(size[q] + 1, np.int64)
            np.add.at(most, own.start, 1)
            np.add.at(most, own.start + own.length + MIN_MATCH - 1, -1)
            if (np.cumsum(most)[:-1] > 0).sum() < threshold * size[q]:
                continue
            whole = (own.length + MIN_MATCH - 1 >= size[q]).any()
            share = 1.0 if whole else tiles(int(size[q]), int(at[d + 1] - at[d]), own) / size[q]
            if share >= threshold:
                yield x + d, block.ids[q], float(share)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield block_of([r["item_id"] for r in rows], [r["text"].encode() for r in rows])


def judged(rows: DataFrame, block: Block, threshold: float) -> DataFrame:
    """Rows (doc_id, text, item_id, coverage) with the best covered item so far, those of the block among them."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    rank = lambda item, share: (share, item is not None, -(item or 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, shares = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for d, item, share in coverages(T.blobs(batch.column(1)), shared.value, threshold):
                if shares[d] is None or rank(item, share) > rank(items[d], shares[d]):
                    items[d], shares[d] = item, share
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(items, pa.int64()), pa.array(shares, pa.float64())], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, contaminated, item_id, coverage) for each row of docs, with the best covered item or null.

    Nothing is shuffled.  With more than one block, rows are written after each but the last.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    rows = docs.select("doc_id", "text", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("double").alias("coverage"))
    for k, block in enumerate(blocks(benchmark, block_bytes)):
        if k:
            rows = scratch.put(f"judged-{k}", rows)
            if k > 1:
                scratch.drop(f"judged-{k - 1}")
        rows = judged(rows, block, threshold)
    return rows.select("doc_id", F.col("coverage").isNotNull().alias("contaminated"), "item_id", "coverage")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The clean documents, all columns as they are; after each block what is left is written."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    names, kept = docs.columns, docs
    for k, block in enumerate(blocks(benchmark, block_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        held = kept.select("text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, _, _ in coverages(T.blobs(batch.column(0)), shared.value, threshold)]] = False
                yield pa.RecordBatch.from_arrays(batch.columns[1:], [f"c{i}" for i in range(len(names))]).filter(pa.array(clean))

        kept = held.mapInArrow(run, ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(kept.dtypes))).toDF(*names)
        if k:
            kept = scratch.put(f"left-{k}", kept)
    return kept
