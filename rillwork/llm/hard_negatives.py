"""Hard negatives by a distributed join over a Voronoi partition.

Vectors are augmented so that a larger inner product is a smaller distance: with
M the largest norm, a row x becomes (x, sqrt(M^2 - |x|^2)) and an anchor q
becomes (q, 0), so that d(q, x)^2 = |q|^2 + M^2 - 2 q.x.  Rows belong to the
nearest of ``PIVOTS`` pivots, a bounded sample.  Anchors of near cells form
groups of bounded size.  A row in cell j can serve an anchor a that looks no
farther than r only if |d(a, p_j) - d(x, p_j)| <= r; the least and the greatest
such distance of a group's anchors, for each cell, decide to which groups a
row is copied.  Each group's rows are dealt out over slices by hash, so that no
group has to meet in one task, and each (group, slice) is joined exactly.

Two joins: the first finds an anchor's nearest rows of its label, with r bounded
by the rows nearest to the pivots; the second finds rows of other labels, with r
given by the least score that is wanted.

Scores are exact integers: products are taken in a type that holds every partial
sum.  Defined cases: rows with a null label, a null vector, or a null or
non-finite component take no part; a null vec_id is no anchor and comes last in
ties; rows with equal vec_id are rows of their own; shorter vectors count as
padded with zeros; components so large that scores would leave 64 bits take the
bound; a negative score of a positive has no negatives, as its range is empty;
anchors without another row of their label have no positives; an empty table
gives an empty result; other columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Pivots, chosen by hash from all rows.
PIVOTS = 64
#: Anchors of a group at most (twice as many if a cell is split).
GROUP = 131_072
#: Rows of a slice: so many, or twice the group's anchors.
SLICE = 1024
#: Scores that a task holds at a time.
TILE = 1 << 22


def integer_rows(rows: DataFrame, relabelled: int, anchors: int) -> DataFrame:
    """(vec_id, label, v, norm, anchor) of the rows that take part; ``v`` has floor(256 * x)."""
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    most = F.floor(F.lit(2.0**31 - 1) / F.sqrt(F.greatest(F.size("embedding"), F.lit(1))))
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256), most), -most).cast("int"))
    label = F.col("label").cast("long")
    chosen = rows.filter(sound).select("vec_id", F.when(F.col("vec_id") % relabelled == 0, (label + 1) % 10).otherwise(label).alias("label"), whole.alias("v"))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    return chosen.select("vec_id", "label", "v", norm.alias("norm"), F.coalesce(F.col("vec_id") % anchors == 0, F.lit(False)).alias("anchor"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int32)
    out[np.repeat(np.arange(len(column)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _chain(pivots: np.ndarray) -> np.ndarray:
    """The pivots, each followed by the nearest of those left, so that near cells have near numbers."""
    left, order = list(range(1, len(pivots))), [0] if len(pivots) else []
    while left:
        gap = ((pivots[left].astype(float) - pivots[order[-1]]) ** 2).sum(1)
        order.append(left.pop(int(gap.argmin())))
    return pivots[order]


def _placed(rows: DataFrame, pivots: np.ndarray, most: float, anchors: bool) -> DataFrame:
    """Adds ``cell`` and the distance(s): of a row to its cell's pivot as ``dist``, of an anchor to all pivots as ``far``."""
    width = pivots.shape[1]
    p = pivots.astype(float)
    lift = np.sqrt(np.maximum(most - (p * p).sum(1), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), width).astype(float)
            norm = (x * x).sum(1)[:, None]
            own = np.zeros(1) if anchors else np.sqrt(np.maximum(most - norm, 0))
            far = np.sqrt(np.maximum((norm if anchors else most) + most - 2 * (x @ p.T + own * lift), 0))
            cell = far.argmin(1)
            value = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(p), pa.int32()), pa.array(far.ravel())) if anchors else pa.array(far[np.arange(len(x)), cell])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), value], [*batch.schema.names, "cell", "far" if anchors else "dist"])

    schema = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, cell int, {'far array<double>' if anchors else 'dist double'}")


def _dealt(rows: DataFrame, anchors: DataFrame, most: float) -> tuple[DataFrame, DataFrame]:
    """Both sides by (side, part, slice): anchors to all slices of their group, rows to one slice of each group that they might serve.

    ``side`` has to be equal, ``reach`` is how far an anchor looks.
    """
    cells = anchors.groupBy("side", "cell").agg(F.count("*").alias("n"))
    # a row for each side and cell
    before = (F.sum("n").over(Window.partitionBy("side").orderBy("cell")) - F.col("n")).alias("before")
    split = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / GROUP))
    part = (F.expr(f"before div {GROUP}") + F.when(F.col("n") > GROUP, split).otherwise(0)).alias("part")
    anchors = anchors.join(cells.select("side", "cell", "n", before), ["side", "cell"]).select(*anchors.columns, part)
    slices = F.ceil(F.col("rows") / F.greatest(F.lit(SLICE), 2 * F.col("anchors"))).cast("int").alias("slices")
    groups = anchors.groupBy("side", "part").agg(F.count("*").alias("anchors")).join(rows.groupBy("side").agg(F.count("*").alias("rows")), "side").select("side", "part", slices)
    wide = anchors.select("side", "part", "reach", F.posexplode("far").alias("cell", "d"))
    bounds = wide.groupBy("side", "part", "cell").agg(F.min(F.col("d") - F.col("reach")).alias("low"), F.max(F.col("d") + F.col("reach")).alias("high"))
    slack = 1e-6 * (most**0.5 + 1)
    copies = rows.join(bounds.join(groups, ["side", "part"]), ["side", "cell"]).filter((F.col("dist") >= F.col("low") - slack) & (F.col("dist") <= F.col("high") + slack))
    copies = copies.select("side", "part", F.pmod(F.xxhash64("row"), "slices").cast("int").alias("slice"), "row", "vec_id", "label", "v", "norm")
    spread = anchors.join(groups, ["side", "part"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return copies, spread.drop("cell", "far", "reach", "slices")


def _tiles(a: pa.Table, c: pa.Table, width: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Blocks of exact scores of anchors against rows."""
    x, y = _matrix(a["v"].combine_chunks(), width), _matrix(c["v"].combine_chunks(), width)
    bound = float(np.sqrt(float(max(a["norm"].to_numpy())) * float(max(c["norm"].to_numpy()))))
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    x, y = x.astype(kind), y.astype(kind)
    tall = min(len(x), 4096)
    for i in range(0, len(x), tall):
        for j in range(0, len(y), TILE // tall):
            s = x[i : i + tall] @ y[j : j + TILE // tall].T
            yield slice(i, i + tall), slice(j, j + TILE // tall), s


def _first(keys: tuple[np.ndarray, ...], owner: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first k of their owner, in the keys' order (the last key counts most)."""
    order = np.lexsort((*keys, owner))
    who = owner[order]
    start = np.flatnonzero(np.diff(who, prepend=-1))
    place = np.arange(len(who)) - np.repeat(start, np.diff(start, append=len(who)))
    return order[place < k]


def _in_ties(c: pa.Table) -> np.ndarray:
    """The rank of each row among those with equal scores: by id, null ids last."""
    ids = c["vec_id"].combine_chunks()
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))] = np.arange(len(ids))
    return rank


class _Best:
    """The first k rows of each anchor seen so far."""

    def __init__(self, anchors: int, k: int, rank: np.ndarray):
        self.k, self.rank = k, rank
        self.a, self.c, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: what a row's score must reach to be among the first k
        self.least = np.full(anchors, np.iinfo(np.int64).min)

    def add(self, a: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
        a, c, s = np.concatenate((self.a, a)), np.concatenate((self.c, c)), np.concatenate((self.s, s))
        kept = _first((self.rank[c], -s), a, self.k)
        self.a, self.c, self.s = a[kept], c[kept], s[kept]
        n = np.bincount(self.a, minlength=len(self.least))
        full = n == self.k
        self.least[full] = self.s[np.cumsum(n)[full] - 1]


def _positives(width: int, k: int) -> Callable:
    """The first k + 1 rows of each anchor's label, itself among them."""

    def join(a: pa.Table, c: pa.Table) -> pa.Table:
        if not (a.num_rows and c.num_rows):
            return _nothing(_POSITIVE)
        best = _Best(a.num_rows, k + 1, _in_ties(c))
        for i, j, s in _tiles(a, c, width):
            least = best.least[i]
            if s.shape[1] > k + 1 and least.min() == np.iinfo(np.int64).min:
                # the first tile's own first k + 1 rows bound what can be among them
                least = np.maximum(least, np.partition(s, s.shape[1] - k - 1, axis=1)[:, -k - 1].astype(np.int64))
            p, q = np.nonzero(s >= least[:, None])
            best.add(p + i.start, q + j.start, s[p, q].astype(np.int64))
        return pa.table({"anchor": a["row"].take(pa.array(best.a)), "row": c["row"].take(pa.array(best.c)), "positive_id": c["vec_id"].take(pa.array(best.c)), "positive_score": best.s})

    return join


def _negatives(width: int, k: int) -> Callable:
    """For each anchor and positive the first k rows of other labels between the positive's bounds."""

    def join(a: pa.Table, c: pa.Table) -> pa.Table:
        if not (a.num_rows and c.num_rows):
            return _nothing(_NEGATIVE)
        rank, own, other = _in_ties(c), a["label"].to_numpy(), c["label"].to_numpy()
        high = _ragged(a["scores"].combine_chunks())
        low = high - high // 5
        wanted = high >= 0
        found = [_Best(a.num_rows, k, rank) for _ in range(high.shape[1])]
        for i, j, s in _tiles(a, c, width):
            least = np.where(wanted[i], np.maximum(low[i], np.stack([b.least[i] for b in found], 1)), np.iinfo(np.int64).max)
            p, q = np.nonzero((s >= least.min(1)[:, None]) & (s <= high[i].max(1)[:, None]))
            differ = own[i][p] != other[j][q]
            p, q = p[differ], q[differ]
            score = s[p, q].astype(np.int64)
            for n, b in enumerate(found):
                fits = (score >= least[p, n]) & (score <= high[i][p, n])
                b.add(p[fits] + i.start, q[fits] + j.start, score[fits])
        parts = [pa.table({"anchor": a["row"].take(pa.array(b.a)), "place": pa.array(np.full(len(b.a), n, np.int32)), "negative_id": c["vec_id"].take(pa.array(b.c)), "negative_score": b.s}) for n, b in enumerate(found)]
        return pa.concat_tables(parts) if parts else _nothing(_NEGATIVE)

    return join


def _ragged(column: pa.ListArray) -> np.ndarray:
    """Lists as rows of a matrix, filled up with -1."""
    length = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), max(length, default=0)), -1, np.int64)
    out[np.repeat(np.arange(len(column)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = column.flatten().to_numpy()
    return out


_POSITIVE = {"anchor": "long", "row": "long", "positive_id": "long", "positive_score": "long"}
_NEGATIVE = {"anchor": "long", "place": "int", "negative_id": "long", "negative_score": "long"}


def _nothing(schema: dict[str, str]) -> pa.Table:
    return pa.table({c: pa.array([], pa.int32() if k == "int" else pa.int64()) for c, k in schema.items()})


def _met(rows: DataFrame, anchors: DataFrame, most: float, join: Callable, schema: dict[str, str]) -> DataFrame:
    copies, spread = _dealt(rows, anchors, most)
    by = ("side", "part", "slice")
    # both sides come from the same rows: other names for one of them
    copies = copies.toDF(*copies.columns)
    return spread.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(join, ", ".join(f"{c} {k}" for c, k in schema.items()))


def _numbered(rows: DataFrame, by: list[str], score: str, id_: str, k: int, name: str) -> DataFrame:
    order: list[Column] = [F.desc(score), F.asc_nulls_last(id_)]
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def hard_negatives(embeddings: DataFrame, positives: int = 5, negatives: int = 5, anchors: int = 100, relabelled: int = 7) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by ``anchors``.  An anchor's positives are its first other rows of
    the same label; each comes with the first rows of other labels whose score is at most its own and at least 80 % of it.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "hard_negatives")
    # written, so that a row keeps its number
    kept = integer_rows(embeddings.select(F.col("vec_id").cast("long"), "embedding", "label"), relabelled, anchors)
    rows = scratch.put("rows", kept.withColumn("row", F.monotonically_increasing_id()))
    most, width = rows.agg(F.coalesce(F.max("norm"), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "row").limit(PIVOTS).select("v").collect()
    pivots = np.zeros((max(len(sample), 1), width), np.int32)
    for k, r in enumerate(sample):
        pivots[k, : len(r["v"])] = r["v"]
    pivots, most = _chain(pivots), float(most)

    near = _placed(rows, pivots, most, False)
    asked = _placed(rows.filter("anchor"), pivots, most, True).select("row", F.col("vec_id").alias("anchor_id"), "label", "v", "norm", "cell", "far")
    # the rows of a label that are nearest to each pivot bound how far its anchors have to look
    n = positives + 1
    nearest = near.select("label", "cell", "dist").withColumn("n", F.row_number().over(Window.partitionBy("label", "cell").orderBy("dist"))).filter(F.col("n") <= n)
    nearest = nearest.groupBy("label").agg(F.collect_list(F.struct("cell", "dist")).alias("nearest"))
    ways = F.array_sort(F.transform("nearest", lambda s: F.get("far", s["cell"]) + s["dist"]))
    looking = asked.join(nearest, "label").withColumn("reach", F.coalesce(F.get(ways, F.lit(n - 1)), F.lit(float("inf")))).drop("nearest")
    found = _met(near.withColumn("side", F.col("label")), looking.withColumn("side", F.col("label")), most, _positives(width, positives), _POSITIVE)
    found = _numbered(found.filter("anchor <> row"), ["anchor"], "positive_score", "positive_id", positives, "place").drop("row")
    found = scratch.put("positives", found.withColumn("place", (F.col("place") - 1).cast("int")))

    lists = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("scores")).select(F.col("anchor").alias("row"), F.col("scores.positive_score").alias("scores"))
    least = F.array_min(F.filter("scores", lambda s: s >= 0))
    reach = F.sqrt(F.greatest(F.col("norm") + most - 2 * F.ceil(least * 0.8 - 1), F.lit(0.0)))
    looking = asked.join(lists, "row").withColumn("reach", reach).filter(F.col("reach").isNotNull())
    side = F.lit(0).cast("long")
    below = _met(near.withColumn("side", side), looking.withColumn("side", side), most, _negatives(width, negatives), _NEGATIVE)
    below = _numbered(below, ["anchor", "place"], "negative_score", "negative_id", negatives, "rank")
    named = rows.filter("anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return below.join(found, ["anchor", "place"]).join(named, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
