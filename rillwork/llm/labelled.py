"""Bounded samples of labelled texts, for the classifiers that learn from ``labels``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """(label, text) of up to ``per_class`` ids of each label outside the held-out fold, chosen by hash.

    An id with conflicting labels takes the highest.  At most 2 * per_class ids
    are chosen, so that side is broadcast; each comes with one of its texts (the
    least), however many rows have its id.
    """
    ids = labels.filter(fold(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max(label).alias("label"))
    order = [F.xxhash64(F.lit(label), "doc_id"), F.col("doc_id")]
    chosen = None
    for value in (0, 1):
        some = ids.filter(F.col("label") == value).orderBy(*order).limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
