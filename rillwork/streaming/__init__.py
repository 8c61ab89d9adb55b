"""Streaming forms over folders of files, run to the end of what is there.

State is Spark's; results go to Parquet in the folder that all executors share,
``spark.checkpoint.dir``, which a cluster must name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from rillwork.operators.machines import Machine, woken
from rillwork.operators.ordered import free
from rillwork.shared import shared_folder


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at a path, with the schema that they have.

    The path may be a folder or one file; a stream takes a file only from a pattern, so the path is written as one.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(frame: DataFrame, mode: str, root: str | None = None) -> DataFrame:
    """Runs a streaming frame over all input there is and reads back its result.

    ``append`` and ``complete`` only; in complete mode each batch replaces the one before.  Without input the result is
    empty.  A run with the ``root`` of one before goes on where that ended, or was ended.
    """
    spark = frame.sparkSession
    root = root or shared_folder(spark, "stream")
    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    kept = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        if mode == "append":
            query = writer.format("parquet").option("path", f"{root}/out").start()
        else:
            query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/out")).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(STORE) if kept is None else spark.conf.set(STORE, kept)
    if query.lastProgress is None and not _exists(spark, f"{root}/out"):
        return spark.createDataFrame([], frame.schema)
    return spark.read.schema(frame.schema).parquet(f"{root}/out")


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


#: Keyed state with timers needs this store.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Keyed(StatefulProcessor):
    """A machine over one key's rows.

    Rows are held until the watermark has passed them, so that they are stepped through in order whatever the batches;
    the machine is woken in between.  One timer is set for the earliest of what is held or due.
    """

    def __init__(self, machine: Machine, key: str, at: str, order: list[str]):
        self.machine, self.key, self.at, self.order = machine, key, at, order
        self.names = list(dict.fromkeys([at, *order, *machine.reads]))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string, timer long")
        self.held = handle.getListState("held", "row string")

    def _now(self) -> tuple[dict, int | None]:
        found = self.state.get() if self.state.exists() else None
        return (self.machine.start(), None) if found is None else (json.loads(found[0]), found[1])

    def _keep(self, state: dict, timer: int | None, next_us: int | None) -> None:
        """Keeps the state, and sets the timer unless an earlier one is set."""
        at = None if next_us is None else -(-next_us // 1000)
        if at is not None and (timer is None or at < timer):
            self.handle.registerTimer(at)
            timer = at
        if timer is None and state == self.machine.start():
            self.state.clear()
        else:
            self.state.update((json.dumps(state), timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = [[row[n] for n in self.names] for row in rows]
        new = [x for x in new if x[0] is not None]
        self.held.appendList([(json.dumps(x),) for x in new])
        if new:
            state, timer = self._now()
            self._keep(state, timer, min(x[0] for x in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        state, timer = self._now()
        if timer is not None and timer > expiredTimerInfo.getExpiryTimeInMs():
            return
        held = [json.loads(x[0]) for x in self.held.get()] if self.held.exists() else []
        ready = sorted((x for x in held if x[0] <= mark), key=lambda x: [(v is not None, v) for v in x[: len(self.order) + 1]])
        out = Row(self.key, *self.machine.out)
        for x in ready:
            row = dict(zip(self.names, x, strict=True))
            for found in (*woken(self.machine, state, row[self.at]), *self.machine.step(state, row)):
                yield out(key[0], *found)
        # rows up to the watermark come no more
        for found in woken(self.machine, state, mark, True):
            yield out(key[0], *found)
        left = [x for x in held if x[0] > mark]
        self.held.put([(json.dumps(x),) for x in left]) if left else self.held.clear()
        due = self.machine.due(state)
        self._keep(state, None, min([x[0] for x in left] + ([] if due is None else [due]), default=None))


def machine_stream(rows: DataFrame, key: str, at: str, order: list[str], machine: Machine, delay: str) -> DataFrame:
    """(key, what the machine gives) for a stream; ``at`` has the rows' times in microseconds.

    Rows may come up to ``delay`` out of order; those that the watermark has passed in a batch before are dropped.  What is not yet passed by it
    is held, so the result is that of ``walked`` up to the last watermark.
    """
    kinds = dict(rows.dtypes)
    schema = StructType.fromDDL(", ".join([f"`{key}` {kinds[key]}", *(f"`{c}` {k}" for c, k in machine.out.items())]))
    needed = rows.select(*dict.fromkeys([key, at, *order, *machine.reads]))
    time = free("time", needed)
    return needed.withColumn(time, F.timestamp_micros(at)).withWatermark(time, delay).groupBy(key).transformWithState(_Keyed(machine, key, at, order), schema, "Append", "EventTime")
