"""Sharding by a two-pass external shuffle.

Pass one scatters the records by a seeded hash into buckets that fit a task's
memory; pass two puts each bucket in a seeded order by Fisher-Yates.  The
buckets one after the other are a uniformly shuffled sequence, which is cut
into shards whose counts differ by one at most (the law ``rows``).

A rerun gives the same shards, on any cluster: buckets follow the bytes alone,
and a bucket's order starts from its sorted records, not from the order in which
they arrive.  Defined cases: null columns are
values like others (a null text has size 1 and the checksum of an empty text);
repeated rows are separate records; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

N_SHARDS = 16
BUCKET_BYTES = 32 << 20
#: Buckets at least.  Their number must not depend on the cluster, or a rerun elsewhere would order records otherwise.
#: Buckets whose counts are added up before their block is placed.
BLOCK = 4096
LEAST_BUCKETS = 64
#: Records of equal key are spread if they fill more than this part of a bucket.
HOT_PART = 8
#: Hot keys that go to all tasks at most; beyond that records meet them by a shuffle.
HOT_AT_ONCE = 1_000_000
SEED = 11
#: What scatters whole documents, and the size of one in SQL.
DOCUMENT_KEY = ("doc_id", "text")
DOCUMENT_BYTES = "coalesce(octet_length(text), 0) + 64"


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation: from the end, each place changes with one at or before it."""
    order = np.arange(n)
    picks = rng.integers(0, np.arange(n, 0, -1))
    for i, j in zip(range(n - 1, 0, -1), picks.tolist(), strict=False):
        order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(records: DataFrame, key: list[str], n_shards: int = N_SHARDS, bucket_bytes: int = BUCKET_BYTES, record_bytes: str = "length(to_json(struct(*)))", seed: int = SEED) -> DataFrame:
    """The records with ``shard`` and ``slot``, gapless from 0 in each shard.

    ``key`` names the columns whose hash scatters the records, ``record_bytes``
    is a record's size in SQL.  The number of buckets follows the bytes.  Records
    of equal key that would fill much of a bucket are spread copy by copy.
    """
    columns = records.columns
    hashed = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key])
    placed = records.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), hashed.alias("place"))
    sizes = records.select(hashed.alias("place"), F.expr(record_bytes).alias("size")).groupBy("place").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    often = (F.col("n") > 1) & (F.col("size") > bucket_bytes // HOT_PART)
    n_bytes, n_hot = sizes.agg(F.sum("size"), F.count_if(often)).first()
    n = max(LEAST_BUCKETS, -(-int(n_bytes or 0) // bucket_bytes))
    if n_hot:
        # equal records are counted, not gathered; each copy has a place of its own
        hot = sizes.filter(often).select("place")
        hot = F.broadcast(hot) if n_hot <= HOT_AT_ONCE else hot
        copies = placed.join(hot, "place", "left_semi").groupBy("place", "row").count().withColumn("copy", F.explode(F.expr("sequence(1L, count)")))
        own = [F.col("row").getField(c) for c, kind in records.dtypes if "map<" not in kind]
        placed = placed.join(hot, "place", "left_anti").unionByName(copies.select("row", F.xxhash64("place", "copy", *own).alias("place")))
    scattered = placed.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(n)))
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = _starts(counts).toDF("bucket", "start", "total")
    flat = scattered.select("bucket", "place", *[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(columns)])
    tie = [f"c{i}" for i, (c, kind) in enumerate(records.dtypes) if c not in key and not kind.startswith(("array", "map", "struct"))]

    def order(rows: pa.Table, starts: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("place", *tie)])
        out = rows.take(pa.array(fisher_yates(len(rows), np.random.default_rng([seed, rows["bucket"][0].as_py()]))))
        out = out.drop_columns("place").append_column("inside", pa.array(np.arange(len(out), dtype=np.int64)))
        for c in ("start", "total"):
            out = out.append_column(c, pa.array(np.full(len(out), starts[c][0].as_py(), np.int64)))
        return out

    schema = ", ".join(["bucket long", *[f"c{i} {kind}" for i, (_, kind) in enumerate(records.dtypes)], "inside long, start long, total long"])
    # each bucket meets the one row that has its start, so nothing of the number of buckets goes to all tasks
    shuffled = flat.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(order, schema)
    at = F.col("start") + F.col("inside")
    shard = F.expr(f"((start + inside) * {n_shards}) div total")
    # the first place whose shard is k is k * total / n_shards, rounded up
    slot = at - F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]
    return shuffled.withColumn("shard", shard).withColumn("slot", slot).select(*own, F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def _starts(counts: DataFrame) -> DataFrame:
    """(bucket, start, total): how many records the buckets before have; blocks of ``BLOCK`` buckets are added up first."""
    block = F.expr(f"bucket div {BLOCK}").alias("block")
    blocks = counts.groupBy(block).agg(F.sum("n").alias("m"))
    before = blocks.select("block", (F.sum("m").over(Window.orderBy("block")) - F.col("m")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("bucket")) - F.col("n")
    placed = counts.select("bucket", "n", block).join(before, "block")
    return placed.select("bucket", (F.col("before") + inside).alias("start")).join(F.broadcast(counts.agg(F.sum("n").alias("total"))))


def write_shards(shuffled: DataFrame, path: str, n_shards: int = N_SHARDS) -> None:
    """One folder for each shard, its records by slot."""
    shuffled.repartitionByRange(max(n_shards, int(shuffled.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard", "slot").sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The whole documents with ``shard`` and ``slot``."""
    return external_shuffle(docs, list(DOCUMENT_KEY), n_shards, bucket_bytes, DOCUMENT_BYTES, seed)


def shard_manifest(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED, path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each document.

    The documents are sharded whole and written (to ``path``, or a folder that
    all executors share); the manifest is read from what was written.  Own
    columns named shard or slot are written as record_shard and record_slot.
    """
    spark = docs.sparkSession
    path = path or f"{Scratch(spark, 'sharding').root}/shards"
    out = shard_documents(docs.toDF(*[f"record_{c}" if c.lower() in ("shard", "slot") else c for c in docs.columns]), n_shards, seed)
    write_shards(out, path, n_shards)
    written = spark.read.schema(out.schema).parquet(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    return written.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
