"""Order-dependent operators on rows of a stream: runs, sessions, gaps and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(rows: DataFrame, key: str, at: str, order: str, quiet: int) -> DataFrame:
    """Adds ``session``: it rises where more than ``quiet`` passed since the key's row before.

    A null time starts none; a null key is a key of its own.  If the rows have a
    column ``session``, the new one is ``session_``.
    """
    line = Window.partitionBy(key).orderBy(at, order)
    starts = F.coalesce((F.col(at) - F.lag(at).over(line) > quiet).cast("long"), F.lit(0))
    mark = free("starts", rows)
    return rows.withColumn(mark, starts).withColumn(free("session", rows), F.sum(mark).over(line.rowsBetween(Window.unboundedPreceding, 0))).drop(mark)


def free(name: str, rows: DataFrame) -> str:
    """A column name that the rows don't have: this one, or with underscores behind it."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_repeats(rows: DataFrame, key: str, order: list[Column], value: str) -> DataFrame:
    """Rows whose value differs from that of the key's row before; nulls are equal, and the first row stays."""
    line = Window.partitionBy(key).orderBy(*order)
    mark = free("changed", rows)
    changed = (F.row_number().over(line) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(line))
    return rows.withColumn(mark, changed).filter(F.col(mark)).drop(mark)


def gaps(rows: DataFrame, key: str, index: str) -> DataFrame:
    """(key, after, missing) where the key's index skips values."""
    follow = F.lead(index).over(Window.partitionBy(key).orderBy(index))
    return rows.select(key, F.col(index).alias("after"), (follow - F.col(index) - 1).alias("missing")).filter("missing > 0")


def rolling_count(rows: DataFrame, key: str, at: str, span: int) -> Column:
    """How many of the key's rows lie in the ``span`` up to and with the row."""
    return F.count("*").over(Window.partitionBy(key).orderBy(at).rangeBetween(-span, 0))
