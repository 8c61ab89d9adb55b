"""Heavy hitters in bounded memory: a summary of counters that can be merged.

A summary holds at most ``capacity`` counters.  When it has more keys than that,
the lowest go, and the floor rises to the highest count that went; a new key
starts with the floor as count and error.  So a key's true count lies in
[count - error, count], and that of a key without a counter is at most the floor.
Until the first eviction all counts are exact.  A task takes rows many at a time,
so what it holds besides is as many sums again, a stretch's and a batch; a machine
takes one at a time, and a twentieth of the counters goes at once.

Merging adds counts, errors and floors; where a summary has no counter of a key,
its floor counts as both.  Null keys are left out; weights that are null or
below 1 count as 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from .machines import Machine

EVICTED_PART = 20
#: Keys that are summed at once.
STRETCH = 1 << 17


def add(counters: dict, floor: int, capacity: int, key, n: int) -> int:
    """Counts a key ``n`` times; counters are [count, error] by key.  Gives the floor."""
    known = counters.get(key)
    if known is not None:
        known[0] += n
        return floor
    if len(counters) >= capacity:
        lowest = sorted(counters, key=lambda k: (counters[k][0], str(k)))[: max(capacity // EVICTED_PART, 1)]
        floor = max(floor, counters[lowest[-1]][0])
        for k in lowest:
            del counters[k]
    counters[key] = [floor + n, floor]
    return floor


def _taken(held: pa.Table, sums: list[pa.Table], floor: int, capacity: int) -> tuple[pa.Table, int]:
    """The counters (key, n, error) with sums (key, n) of further rows, and the floor: the highest ``capacity`` stay."""
    both = pa.concat_tables([held, *sums], promote_options="default").group_by("key", use_threads=False).aggregate([("n", "sum"), ("error", "max")])
    n, error = both["n_sum"].to_numpy(), both["error_max"]
    known = error.is_valid().to_numpy()
    n, error = np.where(known, n, n + floor), pc.fill_null(error, floor)
    out = pa.table({"key": both["key"], "n": n, "error": error})
    if len(out) > capacity:
        order = np.argpartition(-n, capacity)
        floor = max(floor, int(n[order[capacity]]))
        out = out.take(np.sort(order[:capacity]))
    return out.combine_chunks(), floor


def _sums(batch: pa.RecordBatch, kind: pa.DataType) -> Iterator[pa.Table]:
    """(key, n) of a batch's keys, in stretches."""
    keys, n = batch["key"], batch["n"] if "n" in batch.schema.names else None
    if pa.types.is_list(keys.type) or pa.types.is_large_list(keys.type):
        n = None if n is None else n.take(pc.list_parent_indices(keys))
        keys = pc.list_flatten(keys)
    for i in range(0, len(keys), STRETCH):
        some = pa.table({"key": keys.slice(i, STRETCH).cast(kind)} | ({} if n is None else {"n": n.slice(i, STRETCH)}))
        some = some.filter(pc.field("key").is_valid()) if some["key"].null_count else some
        sums = some.group_by("key", use_threads=False).aggregate([([], "count_all") if n is None else ("n", "sum")])
        yield pa.table({"key": sums["key"], "n": sums["count_all" if n is None else "n_sum"]})


def summaries(rows: DataFrame, key: str, weight: str | None, capacity: int) -> DataFrame:
    """(key, n, error, floor): the counters of each task's rows, and its floor once with a null key; the partial step."""
    held_as = rows.schema[key].dataType
    schema = StructType.fromDDL(f"`{key}` {(held_as.elementType if isinstance(held_as, ArrayType) else held_as).simpleString()}, n long, error long, floor long")
    arrow = to_arrow_schema(schema)
    weights = [] if weight is None else [F.greatest(F.coalesce(F.col(weight), F.lit(1)), F.lit(1)).cast("long").alias("n")]
    pairs = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), *weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.schema([("key", arrow.field(0).type), ("n", pa.int64()), ("error", pa.int64())]).empty_table()
        waiting, size, floor = [], 0, 0
        for batch in batches:
            for sums in _sums(batch, arrow.field(0).type):
                waiting.append(sums)
                size += len(sums)
                if size >= capacity:
                    held, floor = _taken(held, waiting, floor, capacity)
                    waiting, size = [], 0
        if waiting:
            held, floor = _taken(held, waiting, floor, capacity)
        yield from pa.Table.from_arrays([*held.columns, pa.array(np.full(len(held), floor))], schema=arrow).to_batches()
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, floor, 0, 0), arrow, strict=True)], schema=arrow)

    return pairs.mapInArrow(run, schema)


def heavy_hitters(rows: DataFrame, key: str, capacity: int, weight: str | None = None) -> DataFrame:
    """(key, n, error) of at most ``capacity`` keys with the highest counts, highest first.

    Where the key is an array, each of its elements counts, with the row's weight; that spares a row for each.
    Each task's summary has at most ``capacity`` counters, however many keys there are; they are merged by key.
    """
    held = summaries(rows, key, weight, capacity).groupBy(key).agg(F.sum("n").alias("n"), F.sum("error").alias("error"), F.sum("floor").alias("floor"))
    # all floors together, the row with the null key, come first; as they are the same for all keys, they don't change the order
    top = held.orderBy(F.col(key).isNotNull(), F.desc(F.col("n") - F.col("floor")), key).limit(capacity + 1)
    floors = F.max(F.when(F.col(key).isNull(), F.col("n"))).over(Window.partitionBy())
    # where a task has no counter of the key
    without = F.col("floors") - F.col("floor")
    merged = top.withColumn("floors", floors).filter(F.col(key).isNotNull()).select(key, (F.col("n") + without).alias("n"), (F.col("error") + without).alias("error"))
    return merged.orderBy(F.desc("n"), key).limit(capacity)


class Hitters(Machine):
    """(rank, value, n, error): the top of a key's bounded summary, ``every_us`` after a row and each such time on while rows come, and at the end.

    For streams: memory is ``capacity`` counters for each key.  Rows with a null time are left out.
    """

    out = {"at_us": "long", "rank": "int", "value": "string", "n": "long", "error": "long"}

    def __init__(self, at: str, value: str, weight: str | None, capacity: int, top: int, every_us: int):
        self.at, self.value, self.weight, self.capacity, self.top, self.every = at, value, weight, capacity, top, every_us
        self.reads = (at, value, *([weight] if weight else []))

    def step(self, state: dict, row: dict) -> Iterator[tuple]:
        if row[self.at] is not None and row[self.value] is not None:
            if "due" not in state or state["due"] < row[self.at]:
                state["due"] = row[self.at] + self.every
            state["last"] = row[self.at]
            counters = state.setdefault("counters", {})
            state["floor"] = add(counters, state.get("floor", 0), self.capacity, str(row[self.value]), max((row[self.weight] if self.weight else None) or 1, 1))
        return iter(())

    def _said(self, state: dict, at: int) -> Iterator[tuple]:
        first = sorted(state["counters"].items(), key=lambda x: (-x[1][0], x[0]))[: self.top]
        for rank, (value, (n, error)) in enumerate(first, 1):
            yield at, rank, value, n, error

    def due(self, state: dict) -> int | None:
        return state["due"] if state and state["due"] <= state["last"] + self.every else None

    def wake(self, state: dict, at: int) -> Iterator[tuple]:
        yield from self._said(state, at)
        state["due"] = at + self.every

    def end(self, state: dict) -> Iterator[tuple]:
        if state:
            yield from self._said(state, state["last"])
