"""Queries of the operational store: lookups, paging, status counts, retention and layered settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import free


def page(rows: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)


def status_pivot(rows: DataFrame, status: str, values: tuple[str, ...]) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values])


def keep_newest(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The k first rows of each key, with ``place`` (``place_`` if the rows have that); the window is cut to k rows before the shuffle."""
    place = free("place", rows)
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(place) <= k)


def next_index(rows: DataFrame, key: str, index: str) -> DataFrame:
    return rows.groupBy(key).agg((F.coalesce(F.max(index), F.lit(-1)) + 1).cast("long").alias("next_index"))


def without_oldest(rows: DataFrame, order: list[Column], n: int, key: str) -> DataFrame:
    """The rows left when a batch of the n first ones is deleted; n is a parameter, so the batch is small."""
    batch = rows.orderBy(*order).limit(n).select(key)
    return rows.join(batch, key, "left_anti")


def keep_last_set(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """One row for each key with the last value of each column that isn't null: upserts that keep the old on null."""
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def replace_all(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """One row for each key, the last: upserts that replace every column, by null too."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("last"))
    return last.select(key, *[F.col("last").getField(c).alias(c) for c in columns])


def ingest(rows: DataFrame, key: str, order: str, value: str, finished: Column) -> DataFrame:
    """(key, generation, refreshed, duplicates): sightings of a key after it is finished are duplicates; before, a changed value starts a generation."""
    line = Window.partitionBy(key).orderBy(order)
    seen = rows.select(key, order, F.col(value).alias("value"), F.coalesce(finished, F.lit(False)).alias("done"))
    seen = seen.withColumn("was_done", F.coalesce(F.max("done").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    seen = seen.withColumn("changed", ~F.col("was_done") & (F.row_number().over(line) > 1) & ~F.col("value").eqNullSafe(F.lag("value").over(line)))
    return seen.groupBy(key).agg(F.count_if("changed").alias("generation"), F.count_if(~F.col("was_done")).alias("refreshed"), F.count_if("was_done").alias("duplicates"))


def outputs_page(outputs: DataFrame, sessions: DataFrame, session: str, order: list[Column], size: int, offset: int = 0, in_session=None, of_streamer: Column | None = None, search: Column | None = None) -> DataFrame:
    """A page of outputs with ``total``, how many there are; sessions are joined only if a streamer is asked for.

    ``session`` is the column that both have; ``of_streamer`` is a condition on the sessions, ``search`` one on the
    outputs.  The total is counted with the page, in one pass.
    """
    found = outputs if in_session is None else outputs.filter(F.col(session) == in_session)
    found = found if search is None else found.filter(F.coalesce(search, F.lit(False)))
    if of_streamer is not None:
        found = found.join(sessions.filter(of_streamer).select(session), session, "left_semi")
    return page_with_total(found, order, size, offset)


def page_with_total(rows: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """A page of the rows with ``total`` (``total_`` if they have that): one row, counted apart, goes to the page."""
    total = rows.agg(F.count("*").alias(free("total", rows)))
    return page(rows, order, size, offset).crossJoin(F.broadcast(total))


def active(rows: DataFrame, revoked: str, expires: str, now, order: list[Column]) -> DataFrame:
    """Rows that aren't revoked and expire later than now, in order; a null expiry counts as expired."""
    return rows.filter(F.col(revoked).isNull() & (F.col(expires) > now)).orderBy(*order)


def undelivered(outbox: DataFrame, id_: str, delivered: str, limit: int) -> DataFrame:
    """The first entries of an outbox that aren't delivered, by id."""
    return outbox.filter(F.col(delivered).isNull()).orderBy(id_).limit(limit)


def after_delivery(outbox: DataFrame, results: DataFrame, id_: str, now) -> DataFrame:
    """The outbox after a delivery: (id, error) of the entries tried; a null error is a success.

    Tried entries count one attempt more and have the error, or none and the time ``delivered_at``.  An entry that was
    delivered before stays as it is, so a repeated delivery changes nothing; of repeated results a success counts.
    """
    tried = results.groupBy(id_).agg(F.when(F.bool_or(F.col("error").isNull()), None).otherwise(F.min("error")).alias("new_error"), F.lit(True).alias("tried"))
    open_ = F.coalesce("tried", F.lit(False)) & F.col("delivered_at").isNull()
    joined = outbox.join(tried, id_, "left")
    changed = {"attempts": F.when(open_, F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts")), "last_error": F.when(open_, F.col("new_error")).otherwise(F.col("last_error")), "delivered_at": F.when(open_ & F.col("new_error").isNull(), now).otherwise(F.col("delivered_at"))}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in outbox.columns])


def timeline(rows: DataFrame, key: str, order: str, starts: str, ends: str, reason: str) -> DataFrame:
    """(key, n, first_start, last_end, longest, first_reason): parts of each key as one line; the first reason that isn't null, in order.

    Parts without an end have no length.
    """
    long_ = F.when(F.col(ends).isNotNull(), F.greatest(F.col(ends) - F.col(starts), F.lit(0)))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(starts).alias("first_start"), F.max(ends).alias("last_end"), F.max(long_).alias("longest"), F.min_by(reason, F.when(F.col(reason).isNotNull(), F.col(order))).alias("first_reason"))


def layered(layers: list[tuple[DataFrame, str]], rows: DataFrame, columns: dict[str, int | None]) -> DataFrame:
    """Rows with each setting from the first layer that has it: (frame, key) pairs, the nearest layer first.

    Layers are joined on their key, which rows have too, and have the settings' columns.  A setting with a floor is at
    least that.  A null in a layer means it doesn't say; a key of which a layer has several rows takes the least row.
    """
    out, asked = rows, []
    for i, (frame, key) in enumerate(layers):
        one = frame.groupBy(key).agg(F.min(F.struct(*columns)).alias(f"layer_{i}"))
        out = out.join(one, key, "left")
        asked.append(f"layer_{i}")
    chosen = {c: F.coalesce(*[F.col(f"{a}.{c}") for a in asked]) for c in columns}
    return out.select(*rows.columns, *[(v if columns[c] is None else F.greatest(v, F.lit(columns[c]))).alias(c) for c, v in chosen.items()])
