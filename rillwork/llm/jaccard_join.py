"""N-gram Jaccard join over size-banded tiles with bitmap signatures.

A document's set is its distinct word shingles, as 64-bit hashes.  Documents with
equal sets are one class, so copies are never compared.  Classes meet in tiles:
a tile is a size band and a shingle of the sets' prefixes (in an order by which
frequent shingles come last, two sets that are similar enough share one there).
Inside a tile sizes, places in the prefixes and the bit counts of hashed bitmap
signatures bound the overlap from above before a pair is made; what pairs are
left are bounded by larger bitmaps, and those that still may reach the threshold
have their sorted arrays intersected, which is exact.

In a tile of copies most classes are alike.  So each class is first compared with
two pivots of its tiles; what links is joined to components, and afterwards
only pairs in different components are compared.  No component is missed, as
every pair that meets in a tile is compared or known to be connected.  The
result is components, not links: pairs known to be connected aren't compared.
A tile of a shingle that stands out is dealt into parts, by which its rows and
its comparisons are spread over tasks.

Defined cases: a text with fewer words than a shingle is one whole shingle; null
and empty texts, and texts without words, have the empty set and link with
nothing; repeated rows and equal texts are linked; an empty table gives an empty
result.  Ids must not be null; rows with a null id are kept and link with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .components import components
from .scratch import Scratch

#: Cells in which shingles are counted, for their order; a bound on what is broadcast.
CELLS = 1 << 20
#: Cells whose counts are one row; a count takes as many bytes as the largest of its row.
BLOCK = 1 << 10
#: Rounds of comparing each set with two pivots of each of its tiles, at most; one follows if this share of a round's pairs linked.
PIVOT_ROUNDS, LEAST_LINKED = 2, 0.5
#: Shingles that stand out by more occurrences than this have their tiles dealt into parts of about so many.
HOT_ROWS = 20_000
#: Pairs of one document that a task verifies at most, roughly.
PAIRS_PER_PART = 1000
#: 64-bit words of the signature that tiles are compared by.
SIG_WORDS = 16
#: Bits of a signature for each shingle, up to the next power of two.
BITS_PER_SHINGLE = 2


def _sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    return T.distinct(*T.grams(*T.words(texts), n))


def _cell(v: np.ndarray) -> np.ndarray:
    return (T.mixed(v ^ np.uint64(77)) & np.uint64(CELLS - 1)).astype(np.int64)


def _set_digests(v: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two digests of each set."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mixed(v ^ np.uint64(salt)), dtype=np.uint64)]) for salt in (1, 2)]
    return [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]


def _digests(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, counts): a digest of each document's set.

    Where ``counts`` isn't null, it has how many shingles fall in the cells of a block (h1) in some part of the table.
    """
    names = ["doc_id", "n_shingles", "h1", "h2", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(CELLS, np.int64)
        for batch in batches:
            texts = T.blobs(batch.column(1))
            size, one, two = [], [], []
            for i, j in T.chunks(texts):
                v, at = _sets(texts[i:j], n)
                count += np.bincount(_cell(v), minlength=CELLS)
                for digest, out in zip(_set_digests(v, at), (one, two), strict=True):
                    out.append(digest)
                size.append(np.diff(at))
            flat = [pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in (size, one, two)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *flat, pa.nulls(batch.num_rows, pa.binary())], names)
        none = pa.nulls(CELLS // BLOCK, pa.int64())
        packed = [c.astype(np.min_scalar_type(c.max())).tobytes() for c in count.reshape(-1, BLOCK)]
        yield pa.RecordBatch.from_arrays([none, none, pa.array(np.arange(CELLS // BLOCK)), none, pa.array(packed, pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, counts binary")


def _cell_counts(digests: DataFrame, scratch: Scratch) -> np.ndarray:
    """How many shingles fall in each cell; a task adds up the blocks that are dealt to it, one row after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(packed, f"u{len(packed) // BLOCK}").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["h1", "counts"])

    found = scratch.put("counts", digests.filter("counts is not null").select("h1", "counts").repartition("h1").mapInArrow(run, "h1 long, counts binary")).toArrow()
    scratch.drop("counts")
    out = np.zeros((CELLS // BLOCK, BLOCK), np.int64)
    for block, packed in zip(found["h1"].to_pylist(), found["counts"].to_pylist(), strict=True):
        out[block] = np.frombuffer(packed, np.int64)
    return out.ravel()


def _required(n: Column, other: Column, percent: int) -> Column:
    """percent * (both sizes): what (100 + percent) * overlap must reach for a link."""
    return F.lit(percent) * (n + other)


def _set_rows(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig, bits, prefix, parts) of each document with a set.

    ``sig`` is a signature of fixed length in which each shingle flips a bit;
    ``bits`` one that grows with the set, in which each sets a bit.  ``prefix``
    are the rarest shingles in order, ``parts`` how many tiles each is dealt to.
    """
    # shingles are ordered by the count of their cell, then by hash: what stands out from the usual count comes last
    usual = max(float(np.median(counts)), 1.0)
    parts = np.clip(np.ceil((counts - 2 * usual) / HOT_ROWS), 1, 1 << 15).astype(np.int16)
    shared = docs.sparkSession.sparkContext.broadcast((np.minimum(counts, (1 << 24) - 1).astype(np.uint32), parts))
    names = ["doc_id", "n_shingles", "h1", "h2", "sig", "bits", "prefix", "parts"]

    def lists(flat: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, flat)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*flat, np.zeros(0, np.int64)]), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, dealt = shared.value
        for batch in batches:
            texts = T.blobs(batch.column(1))
            for i, j in T.chunks(texts):
                v, at = _sets(texts[i:j], n)
                if not len(v):
                    continue
                low, cell = T.mixed(v), _cell(v)
                place = (often[cell].astype(np.uint64) << np.uint64(40)) | (low >> np.uint64(24))
                size = np.diff(at)
                one, two = _set_digests(v, at)
                some = np.flatnonzero(size)
                flip = np.uint64(1) << (low >> np.uint64(40) & np.uint64(63))
                word = (low >> np.uint64(46) & np.uint64(SIG_WORDS - 1)).astype(np.int64)
                sig = np.stack([np.bitwise_xor.reduceat(np.where(word == k, flip, np.uint64(0)), at[some]) for k in range(SIG_WORDS)], 1)
                bits, prefix, deal = [], [], []
                for x, y in zip(at[some].tolist(), at[some + 1].tolist(), strict=True):
                    width = max(64, 1 << math.ceil(math.log2((y - x) * BITS_PER_SHINGLE)))
                    b = np.zeros(width, np.uint8)
                    b[(low[x:y] & np.uint64(width - 1)).astype(np.int64)] = 1
                    bits.append(np.packbits(b).tobytes())
                    # similar sets share more than size - ceil(percent * size / 100) shingles with each
                    first = x + np.argsort(place[x:y], kind="stable")[: y - x - -(-percent * (y - x) // 100) + 1]
                    prefix.append(v[first].view(np.int64))
                    deal.append(dealt[cell[first]])
                flat = pa.array(sig.view(np.int64).ravel())
                rows = [batch.column(0).cast(pa.int64()).slice(i, j - i).take(pa.array(some)), *[pa.array(a[some]) for a in (size, one, two)]]
                rows += [pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SIG_WORDS), pa.int32()), flat), pa.array(bits, pa.binary()), lists(prefix, pa.int64()), lists(deal, pa.int32())]
                yield pa.RecordBatch.from_arrays(rows, names)

    kinds = "doc_id long, n_shingles long, h1 long, h2 long, sig array<long>, bits binary, prefix array<long>, parts array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def _bound_by_bits(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bit counts allow a link."""
    for k in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            most = np.minimum(na, nb)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                # the signature of the larger set may be wider: its bit i is bit i modulo the width of the smaller
                if len(p) > len(q):
                    p = np.bitwise_or.reduce(p.reshape(-1, len(q)), axis=0)
                elif len(q) > len(p):
                    q = np.bitwise_or.reduce(q.reshape(-1, len(p)), axis=0)
                # each bit that only one set has is at least one shingle that the other lacks
                most[i] = min(most[i], na[i] - int(np.bitwise_count(p & ~q).sum()), nb[i] - int(np.bitwise_count(q & ~p).sum()))
            yield batch.select(["a", "b"]).filter(pa.array(100 * most >= percent * (na + nb - most)))

    return pairs.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long")


def _arrays(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, shingles, parts): the sorted arrays of the rows of ``ids`` (id, parts), equal ones of an id once for each task."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            texts, ids, parts = T.blobs(batch.column(1)), batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j in T.chunks(texts):
                v, at = _sets(texts[i:j], n)
                own = [k for k in range(j - i) if at[k] < at[k + 1]]
                fresh = [k for k in own if (key := (ids[i + k], hash(v[at[k] : at[k + 1]].tobytes()))) not in seen and not seen.add(key)]
                if fresh:
                    flat = [v[at[k] : at[k + 1]].view(np.int64) for k in fresh]
                    ends = np.cumsum([0, *map(len, flat)])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i + k] for k in fresh], pa.int64()), lists, pa.array([parts[i + k] for k in fresh], pa.int32())], ["id", "shingles", "parts"])

    return wanted.mapInArrow(run, "id long, shingles array<long>, parts int")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, n: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) that link: bit counts first, then the exact intersection of the sorted arrays.

    Arrays are made for the documents of pairs that the bit counts leave; those
    in very many pairs are dealt to several tasks.
    """
    may = scratch.put(f"{name}-may", _bound_by_bits(pairs, sets, percent))
    degree = may.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("m"))
    ids = scratch.put(f"{name}-ids", degree.select("id", F.ceil(F.col("m") / PAIRS_PER_PART).cast("int").alias("parts")))
    arrays = scratch.put(f"{name}-arrays", _arrays(docs, ids, n))
    for k, other in ("ab", "ba"):
        of = arrays.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        may = may.join(ids.select(F.col("id").alias(k), "parts"), k).withColumn("part", F.pmod(F.xxhash64(other), F.col("parts")).cast("int")).join(of, [k, "part"]).drop("part", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = (batch.column(c)[i].values.to_numpy().view(np.uint64) for c in (2, 3))
                k = np.searchsorted(q, p)
                common = int((q[np.minimum(k, len(q) - 1)] == p).sum())
                keep[i] = 100 * common >= percent * (len(p) + len(q) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    out = scratch.put(name, may.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"))
    for part in ("may", "ids", "arrays"):
        scratch.drop(f"{name}-{part}")
    return out


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _tile_rows(sets: DataFrame, percent: int) -> DataFrame:
    """(key, salt, parts, tile, id, n, pos, component, p1, p2): a row for each tile that a prefix puts a set into, with two pivots.

    A tile is a shingle and a band of sizes.  Rows that meet nobody, or nobody
    of a size that allows a link from so late a place of the prefix, are left out.
    """
    flat = sets.select("id", "n", F.posexplode(F.arrays_zip("prefix", "parts"))).select("id", "n", "pos", F.col("col.prefix").alias("key"), F.col("col.parts").alias("parts"))
    dealt = flat.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = dealt.withColumn("m", F.count("*").over(Window.partitionBy("key", "salt"))).filter("m > 1 or parts > 1").drop("m")
    band = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / percent))).cast("int")
    tiles = met.withColumn("tile", F.explode(F.array(band, band + 1)))
    own = Window.partitionBy("key", "salt", "tile")
    central = F.struct("pos", F.xxhash64("id").alias("by"), "id", "n", "component")
    random = F.struct(F.xxhash64("id").alias("by"), "id", "n", "pos", "component")
    rows = tiles.withColumn("component", F.col("id")).withColumn("p1", F.min(central).over(own)).withColumn("p2", F.max(random).over(own)).withColumn("m", F.count("*").over(own)).withColumn("least", F.min("n").over(own))
    useful = (F.col("parts") > 1) | ((F.col("m") > 1) & ((100 + percent) * (F.col("n") - F.col("pos")) >= _required(F.col("n"), F.col("least"), percent)))
    return rows.filter(useful).drop("m", "least")


def _divided(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of tiles that hold more than one component, now with a pivot of the first and one of the last component."""
    own = Window.partitionBy("key", "salt", "tile")
    labelled = rows.drop("p1", "p2", "component").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = F.struct("component", "pos", "id", "n")
    highest = F.struct("component", (-F.col("pos")).alias("back"), "id", "n", "pos")
    return labelled.withColumn("p1", F.min(lowest).over(own)).withColumn("p2", F.max(highest).over(own)).filter("parts > 1 or p1.component <> p2.component")


def _place_fits(n: Column, pos: Column, other_n: Column, other_pos: Column, percent: int) -> Column:
    """Whether what follows their places in the prefixes, which begin with what both have, may be overlap enough."""
    return (100 + percent) * F.least(n - pos, other_n - other_pos) >= _required(n, other_n, percent)


def _sig_fits(n: Column, sig: Column, other_n: Column, other_sig: Column, percent: int) -> Column:
    """Each bit in which signatures differ is a shingle that only one set has."""
    differ = sum((F.bit_count(sig[k].bitwiseXOR(other_sig[k])) for k in range(SIG_WORDS)), F.lit(0))
    return (100 + percent) * (n + other_n - differ) >= 2 * _required(n, other_n, percent)


def _as_links(known: DataFrame) -> DataFrame:
    """The links (a, b) of ids to their components: as connected as those that the components came from, and fewer."""
    return known.select(F.col("id").alias("a"), F.col("component").alias("b"))


def _digest_columns(docs: DataFrame, n: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    seen = scratch.put("digests", _digests(docs, n))
    return seen.filter("counts is null").drop("counts"), _cell_counts(seen, scratch)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document.

    Sets of word n-grams link when 100 * intersection >= percent * union.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    digests, counts = _digest_columns(docs, n, scratch)
    keys = ["n_shingles", "h1", "h2"]
    known_ids = docs.filter("doc_id is not null")
    # one row for each class of equal sets; copies meet on the map side already
    classes = _set_rows(known_ids, n, percent, counts).groupBy(*keys).agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("sig", "bits", "prefix", "parts")])
    sets = scratch.put("sets", classes.withColumnRenamed("n_shingles", "n"))
    left = scratch.put("rows-0", _tile_rows(sets, percent))
    links, used = None, ["rows-0"]
    for k in range(PIVOT_ROUNDS):
        if k:
            # another round is worth its cost if a fair part of what was compared links
            if found.count() <= LEAST_LINKED * compared:
                break
            known = scratch.put(f"known-{k}", components(links, scratch, f"components-{k}"))
            left = scratch.put(f"rows-{k}", _divided(left, known))
            links = _as_links(known)
            used += [f"rows-{k}", f"known-{k}"]
        met = None
        for p in ("p1", "p2"):
            apart = (F.col("component") != F.col(f"{p}.component")) & _place_fits(F.col("n"), F.col("pos"), F.col(f"{p}.n"), F.col(f"{p}.pos"), percent)
            other = left.filter(apart).select("id", F.col(f"{p}.id").alias("other"))
            met = other if met is None else met.unionByName(other)
        pairs = scratch.put(f"pairs-{k}", _pairs(met))
        compared = pairs.count()
        found = _verified(pairs, sets, known_ids, n, percent, scratch, f"links-{k}")
        scratch.drop(f"pairs-{k}")
        links = found if links is None else links.unionByName(found)
        used.append(f"links-{k}")
    known = scratch.put("known", components(links, scratch, "first-components"))
    labelled = left.drop("p1", "p2", "component").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key", "tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key", "tile")
    rest = scratch.put("rest", labelled.join(mixed, ["key", "tile"]).join(sets.select("id", "sig"), "id"))
    x = rest.select("key", "tile", F.col("salt").alias("part"), "id", "n", "pos", "sig", "component")
    y = rest.select("key", "tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"other_{c}") for c in ("id", "n", "pos", "sig", "component")])
    far = F.col("component") != F.col("other_component")
    fits = _place_fits(F.col("n"), F.col("pos"), F.col("other_n"), F.col("other_pos"), percent) & _sig_fits(F.col("n"), F.col("sig"), F.col("other_n"), F.col("other_sig"), percent)
    cross = x.join(y, (x["key"] == y["key"]) & (x["tile"] == y["tile"]) & (x["part"] == y["part"]) & far & (F.col("id") < F.col("other_id")) & fits)
    last = _verified(_pairs(cross.select("id", F.col("other_id").alias("other"))), sets, known_ids, n, percent, scratch, "links")
    final = known
    if not last.isEmpty():
        final = scratch.put("components", components(_as_links(known).unionByName(last), scratch, "all-components"))
    whole = sets.join(final, "id", "left").select(F.col("n").alias("c_n"), F.col("h1").alias("c_h1"), F.col("h2").alias("c_h2"), F.coalesce("component", "id").alias("component"))
    whole = scratch.put("classes", whole)
    for name in (*used, "known", "rest", "links", "sets", "components"):
        scratch.drop(name)
    same = [F.col("n_shingles") == F.col("c_n"), F.col("h1") == F.col("c_h1"), F.col("h2") == F.col("c_h2")]
    return digests.join(whole, [F.col("doc_id").isNotNull(), *same], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def without_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component (the smallest id), all columns as they are.

    Rows of the kept id with equal texts are one document: one of them stays,
    chosen by a hash of its columns.  Rows of one id with different texts are
    told apart and all stay; so do rows with a null id.
    """
    found = jaccard_components(docs.select("doc_id", "text"), n, percent)
    kept = found.filter(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("kept_rows"))
    kept = Scratch(docs.sparkSession, "near-duplicates").put("kept", kept)
    names = docs.columns
    held = docs.select(F.col("doc_id").alias("held_id"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    whole = lambda some: held.join(some, F.col("held_id").eqNullSafe(F.col("kept_id")), "left_semi")
    repeated = F.col("kept_id").isNotNull() & (F.col("kept_rows") > 1)
    if kept.filter(repeated).isEmpty():
        out = whole(kept)
    else:
        by = F.xxhash64(*[F.col("row").getField(c) for c, kind in docs.dtypes if "map<" not in kind])
        one = whole(kept.filter(repeated)).withColumn("by", by).groupBy("held_id", F.col("row").getField("text").alias("of")).agg(F.min_by("row", "by").alias("row"))
        out = whole(kept.filter(~repeated)).select("row").unionByName(one.select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in names])
