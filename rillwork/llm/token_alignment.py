"""Alignment of two tokenizers' tokens over the same bytes.

Token ends are bits of packed words, one bit for each byte; the AND of both
tokenizers' words has the shared cuts.  The set bits of the AND (select) give
the cuts' places, the set bits up to each place in either bitset (rank, by
population counts) give its token ranges, and each group's ranges expand to
links.

Texts are cut before each space that follows a character that isn't white
space.  Neither vocabulary has a token over such a place, so both end a token
there, and what lies between is encoded and aligned once for each task: a
text's results are sums over its pieces.  Where a piece's bytes don't come back,
the text is encoded as a whole and judged as a whole.

Counts of linked id pairs go to all tasks only if there are at most ``PAIRS``
of them; beyond that each document's distinct pairs are joined with them.

Defined cases: texts that are null, empty or don't come back byte for byte have
no tokens, so zeros and an empty digest; repeated rows are documents of their
own and count as such; ties at the highest count are all best; special strings
in texts are plain text; an empty table gives an empty result; other columns of
the input don't matter.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .scratch import Scratch
from .token_count import byte_symbols

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Pairs of ids whose counts go to all tasks: 17 bytes each.
PAIRS = 2_000_000
#: Pieces of text that a task remembers at most; beyond that it forgets all and goes on.
REMEMBERED = 400_000
#: Longer pieces of text aren't remembered.
LONGEST = 512

_CUT = re.compile(r"(?<=\S)(?= )")
_SPACE = "▁"
_SHIFT = np.int64(32)


def packed(ends: np.ndarray, n: int) -> np.ndarray:
    """Bitset of n bytes as 64-bit words: bit i is set if a token ends with byte i."""
    bits = np.zeros(-(-max(n, 1) // 64) * 64, np.uint8)
    bits[ends - 1] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def select(words: np.ndarray) -> np.ndarray:
    """Places of all set bits, ascending."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def rank(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many bits are set up to and with each place."""
    before = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bitwise_count(words), out=before[1:])
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
    return before[word] + np.bitwise_count(words[word] & mask).astype(np.int64)


def groups(ends_a: np.ndarray, ends_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shared cuts over n bytes (the byte each group ends with), and how many tokens of each side end up to each cut."""
    a, b = packed(ends_a, n), packed(ends_b, n)
    cuts = select(a & b)
    return cuts, rank(a, cuts), rank(b, cuts)


def expanded(to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, token of A, token of B) of every link."""
    from_a, from_b = np.concatenate(([0], to_a[:-1])), np.concatenate(([0], to_b[:-1]))
    wide = to_b - from_b
    links = (to_a - from_a) * wide
    group = np.repeat(np.arange(len(to_a)), links)
    k = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
    return group, from_a[group] + k // wide[group], from_b[group] + k % wide[group]


class Tokenizers:
    """Both libraries, and the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = {c: b for b, c in enumerate(byte_symbols())}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.bytes_a[i] = bytes(map(byte.__getitem__, entry))
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = map(self.b.id_to_piece, range(self.b.vocab_size()))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.space_b = self.b.piece_to_id(_SPACE)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text, which begins with a space; B adds that space itself."""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1) if texts else []
        return a, [x or [self.space_b] for x in b]


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))


def _failed(raw: list[bytes], ids: list[list[int]], of: list[bytes]) -> set[int]:
    """Which of the texts their tokens' bytes don't give back."""
    flat = list(map(of.__getitem__, chain.from_iterable(ids)))
    if b"".join(flat) == b"".join(raw):
        ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))))
        if np.array_equal(ends[np.cumsum(list(map(len, ids)))], np.cumsum(list(map(len, raw)))):
            return set()
    return {k for k, (r, x) in enumerate(zip(raw, ids, strict=True)) if b"".join(map(of.__getitem__, x)) != r}


class Aligner:
    """What the pieces of texts that a task has seen give."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (tokenizers.bytes_a, tokenizers.bytes_b))
        self.name = list(map(str, range(max(len(self.size_a), len(self.size_b)))))
        self.forget()

    def forget(self) -> None:
        self.piece: dict[str, int] = {}
        self.failed: set[int] = set()
        self.wide = False
        self.named: list[str] = []
        self.sums = [np.zeros((0, 4), np.int64)]
        self.pairs = [np.zeros(0, np.int64)]
        self.at = [np.zeros(1, np.int64)]

    def _learn(self, texts: list[str]) -> None:
        """Adds pieces: tokens, groups, links, the groups' text and the linked pairs of each."""
        n, base = len(texts), len(self.named)
        self.wide |= max(map(len, texts)) > LONGEST
        self.piece.update(zip(texts, range(base, base + n), strict=True))
        ids_a, ids_b = self.t.encode(texts)
        raw = [t.encode() for t in texts]
        for k in _failed(raw, ids_a, self.t.bytes_a) | _failed(raw, ids_b, self.t.bytes_b):
            self.failed.add(base + k)
            ids_a[k], ids_b[k] = [], []
        flat_a, flat_b = _flat(ids_a), _flat(ids_b)
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, n) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        cuts, to_a, to_b = groups(ends_a, ends_b, int(ends_a[-1]) if len(ends_a) else 0)
        # the piece of each group is that of its last token
        of_group = np.repeat(np.arange(n), n_a)[to_a - 1] if len(cuts) else cuts
        group, a, b = expanded(to_a, to_b)
        of_link = of_group[group]
        counts = [np.bincount(x, minlength=n) for x in (of_group, of_link)]
        self.sums.append(np.stack([n_a, n_b, *counts], 1))
        self.pairs.append(flat_a[a] << _SHIFT | flat_b[b])
        self.at.append(self.at[-1][-1] + np.cumsum(counts[1]))
        # all tokens, those of A before those of B in each group, each with what stands behind it
        line, behind = np.empty(len(flat_a) + len(flat_b), np.int64), np.full(len(flat_a) + len(flat_b), 0)
        in_a, in_b = np.searchsorted(to_a, np.arange(len(flat_a)), "right"), np.searchsorted(to_b, np.arange(len(flat_b)), "right")
        line[np.arange(len(flat_a)) + np.concatenate(([0], to_b))[in_a]] = flat_a
        line[np.arange(len(flat_b)) + to_a[in_b]] = flat_b
        behind[to_a + np.concatenate(([0], to_b))[:-1] - 1] = 1
        behind[to_a + to_b - 1] = 2
        ends = np.cumsum(n_a + n_b)
        behind[ends[n_a > 0] - 1] = 3
        words = [None] * (2 * len(line))
        words[::2], words[1::2] = map(self.name.__getitem__, line.tolist()), map((",", "|", ";", "").__getitem__, behind.tolist())
        i = 0
        for j in (2 * ends).tolist():
            self.named.append("".join(words[i:j]))
            i = j

    def _known(self, texts: list[str]) -> None:
        new = list(dict.fromkeys(t for t in texts if t not in self.piece))
        for i, j in T.chunks([t.encode() for t in new]):
            self._learn(new[i:j])

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
        """For each text its four sums, its digest and the numbers of its pieces; those that fail have zeros, '' and none."""
        cut = [_CUT.split(" " + t) if t else [] for t in texts]
        seen = set().union(*cut)
        if self.wide or len(self.piece) + len(seen.difference(self.piece)) > REMEMBERED:
            self.forget()
        self._known(list(seen))
        whole = {i for i, c in enumerate(cut) if c and self.failed and not self.failed.isdisjoint(map(self.piece.__getitem__, c))}
        for i in whole:
            cut[i] = [" " + texts[i]]
        self._known([cut[i][0] for i in whole])
        numbers = [np.fromiter(map(self.piece.__getitem__, c), np.int64, len(c)) for c in cut]
        numbers = [x[:0] if i in whole and int(x[0]) in self.failed else x for i, x in enumerate(numbers)]
        self.sums, self.pairs, self.at = [np.concatenate(self.sums)], [np.concatenate(self.pairs)], [np.concatenate(self.at)]
        size = np.fromiter(map(len, numbers), np.int64, len(numbers))
        sums = np.zeros((len(texts), 4), np.int64)
        at = np.flatnonzero(size)
        if len(at):
            sums[at] = np.add.reduceat(self.sums[0][np.concatenate(numbers)], (np.cumsum(size) - size)[at])
        digests = [hashlib.sha256(";".join(map(self.named.__getitem__, x.tolist())).encode()).hexdigest() if len(x) else "" for x in numbers]
        return sums, digests, numbers

    def linked(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of each text, given its pieces' numbers: where they start (one more at the end), pairs, how often each occurs."""
        pairs, often = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in numbers:
            if len(x):
                first, last = self.at[0][x], self.at[0][x + 1]
                n = last - first
                every = np.sort(self.pairs[0][np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())])
                new = np.flatnonzero(np.diff(every, prepend=-1))
                pairs.append(every[new])
                often.append(np.diff(new, append=len(every)))
            else:
                pairs.append(x)
                often.append(x)
        return np.cumsum([0, *map(len, pairs[1:])]), np.concatenate(pairs), np.concatenate(often)


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of bounded bytes, with their texts."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        for i, j in T.chunks([(t or "").encode() for t in texts]):
            yield batch.slice(i, j - i), texts[i:j]


def _table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], list(columns))


_SUMS = ("n_a", "n_b", "n_groups", "n_links")
_OUT = ("doc_id", *_SUMS, "n_best", "count_sum", "groups_sha256")


def aligned(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pair, often): a document's distinct linked pairs (A's id << 32 | B's id)
    and how many of its links each has."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Tokenizers(*paths))
        for batch, texts in _batches(batches, 1):
            sums, digests, numbers = aligner.rows(texts)
            at, pair, often = aligner.linked(numbers)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (pair, often.astype(np.int32))]
            yield _table({"doc_id": batch.column(0), **{c: sums[:, k] for k, c in enumerate(_SUMS)}, "groups_sha256": pa.array(digests, pa.string()), "pair": lists[0], "often": lists[1]})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in _SUMS)}, groups_sha256 string, pair array<long>, often array<int>")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each document.

    ``count_sum`` adds up over the links how many documents hold the link's pair of ids; ``n_best`` counts the links
    whose pair has the highest such count of its A id.  The paths name vocabulary files that all executors have.
    """
    import public_tokenizers

    paths = (path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B))
    scratch = Scratch(docs.sparkSession, "token_alignment")
    # written, so that texts are encoded once and a row keeps its number
    rows = scratch.put("rows", aligned(docs, paths).withColumn("row", F.monotonically_increasing_id()))
    found = scratch.put("found", rows.select(F.explode("pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    # one row for each id of A, so no more than its vocabulary has
    most = found.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    counts = found.withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return _summed(rows, counts) if found.count() <= pairs else _joined(rows, counts)


def _summed(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds up in place, with the counts of all pairs in each task."""
    all_ = counts.toArrow().sort_by("pair")
    known = rows.sparkSession.sparkContext.broadcast(tuple(all_[c].to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = known.value
        for batch in batches:
            rest = dict(zip(batch.schema.names, batch.columns, strict=True))
            pair, often = rest.pop("pair"), rest.pop("often").flatten().to_numpy()
            at = np.searchsorted(pairs, pair.flatten().to_numpy())
            edge = pair.offsets.to_numpy() - pair.offsets[0].as_py()
            for name, value in (("n_best", best[at] * often), ("count_sum", n[at] * often)):
                total = np.concatenate(([0], np.cumsum(value, dtype=np.int64)))
                rest[name] = total[edge[1:]] - total[edge[:-1]]
            yield _table({c: rest[c] for c in _OUT})

    kinds = {**dict(rows.dtypes), "n_best": "long", "count_sum": "long"}
    return rows.drop("row").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in _OUT))


def _joined(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The same with any number of pairs: each document's pairs meet their counts by a join."""
    held = rows.select("row", F.explode(F.arrays_zip("pair", "often")).alias("x")).select("row", "x.pair", "x.often")
    sums = held.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("n_best"), F.sum(F.col("often") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row", "left").select("doc_id", *_SUMS, zero("n_best"), zero("count_sum"), "groups_sha256")
