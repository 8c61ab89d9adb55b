"""Steps of task graphs: edges, validation, levels, readiness, results.

Steps are rows (dag, step, deps, status, outputs) with deps an array of steps of
the same dag.  A null deps array is empty.  What a step waits for but isn't
there counts as not done.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.shared import shared_folder


def edges(steps: DataFrame) -> DataFrame:
    """(dag, step, place, dep): what each step waits for, in order."""
    return steps.select("dag", "step", F.posexplode(F.coalesce("deps", F.array().cast("array<long>"))).alias("place", "dep"))


def roots(steps: DataFrame) -> DataFrame:
    return steps.filter(F.size(F.coalesce("deps", F.array().cast("array<long>"))) == 0)


def leaves(steps: DataFrame) -> DataFrame:
    return steps.join(edges(steps).select("dag", F.col("dep").alias("step")), ["dag", "step"], "left_anti")


def ready(steps: DataFrame) -> DataFrame:
    """(dag, step) of pending steps all of whose dependencies are completed."""
    done = steps.select("dag", F.col("step").alias("dep"), F.col("status") == "COMPLETED").toDF("dag", "dep", "done")
    open_ = edges(steps).join(done, ["dag", "dep"], "left").filter("not coalesce(done, false)").select("dag", "step")
    return steps.filter("status = 'PENDING'").select("dag", "step").join(open_, ["dag", "step"], "left_anti")


def levels(steps: DataFrame, at_once: int = 100_000) -> DataFrame:
    """(dag, step, level): the longest way from a step that waits for nothing; steps on or behind a cycle have none and are left out.

    Repeated steps are one, with all their dependencies; a dependency that isn't there doesn't count.
    Dags of up to ``at_once`` steps are sorted each in one task; larger ones level by level, every level written.
    """
    known = _known(steps)
    sized = steps.groupBy("dag").agg((F.count("*") <= at_once).alias("small"))
    small = known.join(sized.filter("small").select("dag"), "dag", "left_semi")
    schema = ", ".join(f"{c} {k}" for c, k in known.select("dag", "step").dtypes) + ", level long"
    found = small.groupBy("dag").applyInPandas(_sorted_dag, schema)
    large = sized.filter("not small").select("dag")
    return found if large.isEmpty() else found.unionByName(_by_level(known.join(large, "dag", "left_semi"), schema))


def _known(steps: DataFrame) -> DataFrame:
    """(dag, step, dep): each step's distinct dependencies that are there, or one row with none."""
    named = steps.select("dag", "step").distinct()
    there = edges(steps).select("dag", "step", "dep").distinct().join(named.withColumnRenamed("step", "dep"), ["dag", "dep"], "left_semi")
    return named.join(there, ["dag", "step"], "left").select("dag", "step", "dep")


def _sorted_dag(rows: pd.DataFrame) -> pd.DataFrame:
    waits: dict = {}
    follow: dict = {}
    for step, dep in zip(rows["step"], rows["dep"], strict=True):
        waits.setdefault(step, 0)
        if not pd.isna(dep):
            waits[step] += 1
            follow.setdefault(dep, []).append(step)
    level = {step: 0 for step, n in waits.items() if n == 0}
    front = list(level)
    for step in front:
        for after in follow.get(step, ()):
            waits[after] -= 1
            if not waits[after]:
                level[after] = level[step] + 1
                front.append(after)
    return pd.DataFrame({"dag": [rows["dag"].iloc[0]] * len(level), "step": list(level), "level": list(level.values())})


def _by_level(known: DataFrame, schema: str) -> DataFrame:
    """Levels of dags of any size: a step's level is that of the front in which the last of its dependencies is met."""
    spark = known.sparkSession
    root = shared_folder(spark, "levels")
    put = lambda name, frame: (frame.write.parquet(f"{root}/{name}"), spark.read.schema(frame.schema).parquet(f"{root}/{name}"))[1]
    links = put("links", known.filter("dep is not null"))
    waits = put("waits-0", known.groupBy("dag", "step").agg(F.count("dep").alias("n")))
    k = 0
    while True:
        front = put(f"front-{k}", waits.filter("n = 0").select("dag", "step").withColumn("level", F.lit(k).cast("long")))
        if front.isEmpty():
            break
        met = links.join(front.select("dag", F.col("step").alias("dep")), ["dag", "dep"]).groupBy("dag", "step").agg(F.count("*").alias("met"))
        k += 1
        waits = put(f"waits-{k}", waits.filter("n > 0").join(met, ["dag", "step"], "left").select("dag", "step", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n")))
    return spark.read.schema(schema).parquet(*[f"{root}/front-{i}" for i in range(k + 1)])


def fan_in(steps: DataFrame) -> DataFrame:
    """(dag, step, inputs): the outputs of a step's dependencies in their order, repeated ones once."""
    given = steps.select("dag", F.col("step").alias("dep"), "outputs")
    rows = edges(steps).join(given, ["dag", "dep"]).groupBy("dag", "step").agg(F.array_sort(F.collect_list(F.struct("place", "outputs"))).alias("rows"))
    return rows.select("dag", "step", F.array_distinct(F.flatten(F.transform("rows", lambda r: r["outputs"]))).alias("inputs"))


def completion(steps: DataFrame) -> DataFrame:
    """(dag, total, completed, failed, status)."""
    n = steps.groupBy("dag").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    over = F.col("completed") + F.col("failed") >= F.col("total")
    return n.withColumn("status", F.when(over & (F.col("failed") > 0), "FAILED").when(over, "COMPLETED").otherwise("PROCESSING"))


def fail_fast(steps: DataFrame) -> DataFrame:
    """(dag, step, status): in dags with a failed step what isn't finished is cancelled."""
    failed = steps.filter("status = 'FAILED'").select("dag", F.lit(True).alias("broken")).distinct()
    ended = F.col("status").isin("COMPLETED", "FAILED", "CANCELLED")
    return steps.join(failed, "dag", "left").select("dag", "step", F.when(F.coalesce("broken", F.lit(False)) & ~ended, "CANCELLED").otherwise(F.col("status")).alias("status"))


def leaf_outputs(steps: DataFrame) -> DataFrame:
    """(dag, outputs): what the leaves give, in the order of the steps."""
    rows = leaves(steps).groupBy("dag").agg(F.array_sort(F.collect_list(F.struct("step", "outputs"))).alias("rows"))
    return rows.select("dag", F.flatten(F.transform("rows", lambda r: r["outputs"])).alias("outputs"))


def problems(steps: DataFrame, dags: DataFrame | None = None, at_once: int = 100_000) -> DataFrame:
    """(dag, problem): duplicate steps, missing dependencies, no root, cycles; empty ones if ``dags`` lists all dags.

    A missing dependency by itself is no cycle.
    """
    named = lambda d, text: d.select("dag").distinct().withColumn("problem", F.lit(text))
    twice = steps.groupBy("dag", "step").count().filter("count > 1")
    missing = edges(steps).select("dag", F.col("dep").alias("step")).join(steps.select("dag", "step"), ["dag", "step"], "left_anti")
    rootless = steps.select("dag").distinct().join(roots(steps).select("dag").distinct(), "dag", "left_anti")
    cyclic = steps.select("dag", "step").join(levels(steps, at_once).select("dag", "step"), ["dag", "step"], "left_anti")
    found = named(twice, "duplicate").unionByName(named(missing, "missing")).unionByName(named(rootless, "no root")).unionByName(named(cyclic, "cycle"))
    return found if dags is None else found.unionByName(named(dags.select("dag").join(steps, "dag", "left_anti"), "empty"))
