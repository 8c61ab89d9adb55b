"""Rolling state by key: failures, backoff, throttling, coalescing and hysteresis.

A key's rows are ordered by time, then sequence, and meet in one task.  Null
flags count as false, a null key is a key of its own, and rows with a null time
are left out of what depends on time.  If the rows have a column of the name
that an operator adds, the added one has an underscore behind its name; all
columns of the rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import machines
from .ordered import free


def backoff(failures: Column, threshold: int, base_ms: int, most_ms: int, most_exponent: int = 16) -> Column:
    """0 below the threshold, then base * 2 ** (failures - threshold), up to a bound."""
    exponent = F.least(failures - threshold, F.lit(most_exponent))
    return F.when(failures < threshold, 0).otherwise(F.least(F.lit(base_ms) * F.pow(F.lit(2), exponent), F.lit(most_ms))).cast("long")


def consecutive(rows: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """Adds ``streak``: failures in a row up to and with this one, 0 at a success."""
    bad, island = free("failed", rows), free("island", rows)
    line = Window.partitionBy(key).orderBy(order)
    islands = rows.withColumn(bad, F.coalesce(failed, F.lit(False))).withColumn(island, F.sum(F.when(F.col(bad), 0).otherwise(1)).over(line))
    return islands.withColumn(free("streak", rows), F.count_if(bad).over(Window.partitionBy(key, island).orderBy(order))).drop(bad, island)


def throttled(key: str, order: str, depth: Column, warning: int, critical: int) -> Column:
    """Whether throttling is on: since a depth above critical, until one below warning."""
    turn = F.when(depth > critical, True).when(depth < warning, False)
    return F.coalesce(F.last(turn, ignorenulls=True).over(Window.partitionBy(key).orderBy(order)), F.lit(False))


def coalesced(rows: DataFrame, at: str, width: int, key: Column, everything: Column) -> DataFrame:
    """(bucket, all_keys, keys): the distinct keys updated in each window of time; one global update stands for all."""
    grouped = rows.groupBy(F.call_function("div", F.col(at), F.lit(width)).alias("bucket")).agg(F.max(everything).alias("all_keys"), F.array_sort(F.collect_set(key)).alias("keys"))
    return grouped.withColumn("keys", F.when(F.col("all_keys"), F.array().cast("array<string>")).otherwise(F.col("keys")))


def hysteresis_sessions(rows: DataFrame, key: str, at: str, order: str, ends: Column, definite: Column, window: int) -> DataFrame:
    """Adds ``session``: an end is confirmed if nothing but ends follows within the window, a definite end at once.

    ``machines.Sessions`` gives the sessions themselves, with their bounds.
    """
    end, sure, alive, since, starts = (free(c, rows) for c in ("ends", "definite", "alive", "since", "starts"))
    line = Window.partitionBy(key).orderBy(at, order)
    back = rows.withColumn(end, F.coalesce(ends, F.lit(False))).withColumn(sure, F.coalesce(definite, F.lit(False)))
    was = lambda c: F.lag(c).over(line)
    # since when the key has been ended: the first of a run of ends
    run = back.withColumn(alive, F.max(F.when(~F.col(end), F.col(at))).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    first_end = F.min(F.when(F.col(end), F.col(at))).over(Window.partitionBy(key, alive).orderBy(at, order))
    run = run.withColumn(since, F.when(F.col(end), first_end))
    begins = ~F.col(end) & (F.coalesce(was(sure), F.lit(False)) | F.coalesce(F.col(at) - was(since) > window, F.lit(False)))
    run = run.withColumn(starts, begins.cast("long"))
    return run.withColumn(free("session", rows), F.sum(starts).over(line)).drop(end, sure, alive, since, starts)


def offline_signals(rows: DataFrame, key: str, at: str, order: str, failed: str, window: int, threshold: int) -> DataFrame:
    """(key, order) of the failures at which ``threshold`` ones lie within the window; a signal or a success clears the count.

    What counts depends on the last signal, so each key's rows are walked in order.
    """
    return machines.walked(rows, key, [at, order], machines.Failures(order, at, failed, window, threshold, dict(rows.dtypes)[order]))


def size_estimates(rows: DataFrame, key: str, order: str, size: str, first: int = 2 << 20) -> DataFrame:
    """(key, order, estimate): a moving estimate that takes a quarter from each new size; see ``machines.Estimate``."""
    return machines.walked(rows, key, [order], machines.Estimate(order, size, first, dict(rows.dtypes)[order]))


def coarsened_rate(rows: DataFrame, at_us: str, width_s: int, most: int = 60, day_part: int = 21_600) -> DataFrame:
    """(bucket_s, n, width_s): a rate series whose width doubles until max(most, day_part / width_s) points hold all but the last.

    The budget is that of the width at the start.  Buckets without rows are no points; null times are left out.  The
    points of every doubling are counted in one aggregate over the finest series, so the rows are read once.
    """
    budget = max(most, day_part // width_s)
    bucket = lambda us: F.call_function("div", us, F.lit(1_000_000 * width_s))
    series = rows.filter(F.col(at_us).isNotNull()).groupBy(bucket(F.col(at_us)).alias("b")).agg(F.count("*").alias("n"))
    doubled = series.select("b", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("k")).select("k", F.expr("b div shiftleft(1L, k)").alias("b")).distinct()
    points = doubled.groupBy("k").agg(F.count("*").alias("points")).filter(F.col("points") - 1 <= budget).agg(F.min("k").alias("k"))
    chosen = series.join(F.broadcast(points)).withColumn("w", F.expr("shiftleft(1L, k)"))
    return chosen.groupBy((F.expr("b div w") * F.col("w") * width_s).alias("bucket_s"), (F.col("w") * width_s).alias("width_s")).agg(F.sum("n").alias("n"))


#: Failures after which a fetch is tried again, whatever its URL; 401 and 403 need a new URL.
RETRIED, RENEWED = ("404", "429", "5xx", "network", "timeout", "decode", "over_budget"), ("401", "403")


def retry_verdict(kind: Column, attempt: Column, url_changed: Column, most: int, base_ms: int, budget_ms: int) -> Column:
    """A struct of what a failure's class and attempt ask for: ``verdict`` (retry, terminal) and ``wait_ms``.

    A retry waits base * 2 ** min(attempt - 1, 16); it needs an attempt left and a wait within the budget.  A status of
    5xx counts as one class.  Nulls are terminal, and a terminal failure has no wait.
    """
    known = F.when(kind.rlike("^5[0-9][0-9]$"), "5xx").otherwise(kind)
    wait = F.lit(base_ms) * F.pow(F.lit(2), F.least(attempt - 1, F.lit(16)))
    again = (known.isin(*RETRIED) | (known.isin(*RENEWED) & url_changed)) & (attempt < most) & (wait <= budget_ms)
    retry = F.coalesce(again, F.lit(False))
    return F.struct(F.when(retry, "retry").otherwise("terminal").alias("verdict"), F.when(retry, wait.cast("long")).alias("wait_ms"))
