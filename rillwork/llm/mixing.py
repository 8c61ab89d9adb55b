"""Mixing sources to target weights by Sainte-Laguë apportionment.

DataFrame operations only.  Sizes are words.  Each source has a target share
of all words; equal blocks of words are given to the sources one by one, each
to the source with the highest quotient target / (2 * blocks so far + 1).  A
block is at most 1 / BLOCKS_PER_TARGET of the smallest target (one word at
least), so a small source is served in a corpus of any size.  The documents of
a source stand on a line in seeded order, which is cut into blocks.  Its quotas
say how many blocks each shard gets; they are selected evenly along the line
from a seeded offset on, and each shard's blocks follow those of the shard
before.  A source that gets more blocks than it has gets them repeatedly.

A source's last block may be short, so its taken words depart from its target
by at most about MOST_REPEATS blocks.  One row for each source passes through
one task; documents never do.

Defined cases: a null text has size 0 and gives nothing; a null source is a
source of its own, last in order; repeated rows are separate documents; an
empty table gives an empty result.  Rows are told apart by (doc_id, text), and
rows alike in both are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import SPACE_PATTERN

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source (and so no document) is taken more often than this.
MOST_REPEATS = 3
N_SHARDS = 16
BLOCKS_PER_SHARD = 1024
#: Blocks that the smallest target is worth at least, unless blocks are one word.
BLOCKS_PER_TARGET = 256
SEED = 7
#: The line of a source is laid out in so many parts, so that a source of any size is spread.
LINE_PARTS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE_PATTERN), "")).cast("long"), F.lit(0).cast("long"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, rank, total, target) for rows (source, size).

    Targets share the total by weight; what exceeds a source's cap is shared
    again by weight among the rest.  Sources are ordered by cap / weight: those
    capped are a prefix of that order, so one pass of running sums finds them.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("double")
    per = per.withColumn("rank", F.row_number().over(by_name).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = (
        per.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * MOST_REPEATS)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)))
        .withColumn("capped", F.col("weight") * F.col("level") > F.col("cap"))
    )
    spent = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), zero)
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    return per.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * (F.col("total") - spent) / open_weight)).select("source", "source_size", "rank", "total", "target")


def shard_quotas(targets: DataFrame, n_shards: int = N_SHARDS, blocks_per_shard: int = BLOCKS_PER_SHARD, blocks_per_target: int = 0) -> DataFrame:
    """(source, rank, source_size, target, block, shard, blocks, upto): integer blocks of each source in each shard, and up to its end.

    With ``blocks_per_target`` blocks are no larger than that part of the smallest positive target.

    Sainte-Laguë gives more seats without ever taking one back, so the blocks of
    a shard are the seats of a longer list less those of a shorter one.  The
    seats at a length are found without dealing them all out: a source's seats
    are within (sources * share + 2) of its exact part, so only quotients in
    that range are ranked, 6 rows a source on average.
    """
    every = Window.partitionBy()
    block = F.expr(f"total div {n_shards * blocks_per_shard}")
    if blocks_per_target:
        smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
        block = F.least(block, F.floor(smallest / blocks_per_target))
    ends = targets.withColumn("block", F.greatest(F.lit(1).cast("long"), block)).withColumn("seats", F.expr("total div block")).withColumn("n_sources", F.count("*").over(every)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    share = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(F.lit(0.0))
    ends = (
        ends.withColumn("until", F.expr(f"(seats * (shard + 1)) div {n_shards}"))
        .withColumn("share", share)
        .withColumn("exact", F.col("share") * F.col("until"))
        .withColumn("slack", F.col("n_sources") * F.col("share") + 2)
        .withColumn("low", F.greatest(F.lit(0).cast("long"), F.floor(F.col("exact") - F.col("slack"))))
        .withColumn("high", F.floor(F.col("exact") + F.col("slack")))
    )
    per_shard = Window.partitionBy("shard")
    ranked = (
        ends.withColumn("base", F.sum("low").over(per_shard))
        .withColumn("seat", F.explode(F.expr("sequence(low, high)")))
        .withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc(F.col("target") / (2 * F.col("seat") + 1)), "rank")))
        .withColumn("won", ((F.col("place") <= F.col("until") - F.col("base")) & (F.col("target") > 0)).cast("long"))
    )
    upto = ranked.groupBy("rank", "shard").agg(F.first("source").alias("source"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("block").alias("block"), (F.first("low") + F.sum("won")).alias("upto"))
    earlier = F.coalesce(F.lag("upto").over(Window.partitionBy("rank").orderBy("shard")), F.lit(0).cast("long"))
    return upto.withColumn("blocks", F.col("upto") - earlier).select("source", "rank", "source_size", "target", "block", "shard", "blocks", "upto")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, n_shards: int = N_SHARDS, blocks_per_shard: int = BLOCKS_PER_SHARD, seed: int = SEED, keep: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard, last_shard) for each document; with ``keep`` also ``row``, all its columns.

    A document gives the words of it that lie in selected blocks, once for each
    time that a block is selected.  Its blocks go to the shards from
    ``first_shard`` to ``last_shard``; both are null if it gives nothing.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key"), F.pmod(key, F.lit(LINE_PARTS)).alias("part"), *row)
    # a source as a key that is never null, so that the window and the join after it share one shuffle of the documents
    sized = sized.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    parts = Scratch(docs.sparkSession, "mixing").put("parts", sized.groupBy("source", "part").agg(F.sum("size").alias("size")))
    runs = (
        shard_quotas(source_targets(parts.select("source", "size"), weights), n_shards, blocks_per_shard, BLOCKS_PER_TARGET)
        .groupBy("rank", "source", "source_size", "target", "block")
        .agg(F.array_sort(F.collect_list("upto")).alias("ends"))
        .withColumn("n_blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / F.col("block"))))
        .withColumn("quota", F.least(F.element_at("ends", -1), F.col("n_blocks") * MOST_REPEATS))
        .withColumn("ratio", F.col("quota") / F.col("n_blocks"))
        .withColumn("offset", F.pmod(F.xxhash64(F.lit(seed), F.col("rank")), F.lit(1024)) / 1024)
        .withColumnRenamed("source", "run_source")
    )
    same = F.col("source").eqNullSafe(F.col("run_source"))
    before = F.sum("size").over(Window.partitionBy("rank").orderBy("part")) - F.col("size")
    of_key = F.coalesce(F.concat(F.lit("="), "run_source"), F.lit("")).alias("of_key")
    parts = parts.join(runs, same).select(of_key, F.col("part").alias("of_part"), before.alias("part_start"), *[c for c in runs.columns if c not in ("run_source", "rank")])
    inside = Window.partitionBy("source_key", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    line = sized.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    line = line.join(parts, (F.col("source_key") == F.col("of_key")) & (F.col("part") == F.col("of_part")), "left").withColumn("at", F.col("part_start") + F.col("inside"))

    def seats(block: Column) -> Column:
        """How often the blocks before this one are selected, all together."""
        return F.when(block >= F.col("n_blocks"), F.col("quota")).otherwise(F.floor(block * F.col("ratio") + F.col("offset")))

    def words(place: Column) -> Column:
        """How many words before this place of the line are taken."""
        block = _div(place, F.col("block"))
        return seats(block) * F.col("block") + (place - block * F.col("block")) * (seats(block + 1) - seats(block))

    def shard(seat: Column) -> Column:
        return F.when(F.col("taken") > 0, F.size(F.filter("ends", lambda end: end <= seat)))

    end = F.col("at") + F.col("size")
    line = line.withColumn("taken", F.least(words(end) - words(F.col("at")), F.col("size") * MOST_REPEATS))
    line = line.withColumn("first_shard", shard(seats(_div(F.col("at"), F.col("block"))))).withColumn("last_shard", shard(seats(_div(end - 1, F.col("block")) + 1) - 1))
    return line.select("doc_id", "size", "source_size", "target", "taken", "first_shard", "last_shard", *(["row"] if keep else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each as often as its taken words fill it, rounded to whole texts."""
    got = mix(docs, keep=True, **options)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(1.0)).cast("int")
    return got.withColumn("times", times).filter("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
