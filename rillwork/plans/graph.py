"""Task graphs: parts as steps, ten to a graph, each waiting for one or two before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.operators import graph

from .registry import query

_STEPS = """
with s as (select p_partkey // 10 dag, p_partkey % 10 step, p_size, p_partkey from part),
     t as (select *, list_distinct((case when step >= 1 then [step // 2] else [] end) || (case when step % 4 = 3 then [step - 3] else [] end)) deps0,
                  case p_size % 5 when 0 then 'PENDING' when 1 then 'FAILED' else 'COMPLETED' end status, ['o' || (p_size % 7), 'o' || step] outputs from s),
     steps as (select *, list_sort(deps0) deps from t),
     e as (select dag, step, unnest(deps) dep, generate_subscripts(deps, 1) place from steps) """


def _steps(part: DataFrame) -> DataFrame:
    n = lambda c: F.expr(c).cast("long")
    steps = part.select(n("p_partkey div 10").alias("dag"), n("p_partkey % 10").alias("step"), "p_size")
    one, two = F.when(F.col("step") >= 1, F.array(n("step div 2"))).otherwise(F.array().cast("array<long>")), F.when(F.col("step") % 4 == 3, F.array(F.col("step") - 3)).otherwise(F.array().cast("array<long>"))
    status = F.when(F.col("p_size") % 5 == 0, "PENDING").when(F.col("p_size") % 5 == 1, "FAILED").otherwise("COMPLETED")
    outputs = F.array(F.concat(F.lit("o"), (F.col("p_size") % 7).cast("string")), F.concat(F.lit("o"), F.col("step").cast("string")))
    return steps.select("dag", "step", F.array_sort(F.array_union(one, two)).alias("deps"), status.alias("status"), outputs.alias("outputs"))


@query("part", _STEPS + "select dag, step, dep, cast(place - 1 as int) place from e")
def dag_edges(part: DataFrame) -> DataFrame:
    return graph.edges(_steps(part))


@query("part", _STEPS + "select dag, step from steps where len(deps) = 0")
def dag_roots(part: DataFrame) -> DataFrame:
    return graph.roots(_steps(part)).select("dag", "step")


@query("part", _STEPS + "select dag, step from steps s where not exists (select 1 from e where e.dag = s.dag and e.dep = s.step)")
def dag_leaves(part: DataFrame) -> DataFrame:
    return graph.leaves(_steps(part)).select("dag", "step")


@query("part", _STEPS + "select dag, step from steps s where status = 'PENDING' and not exists (select 1 from e left join steps d on d.dag = e.dag and d.step = e.dep where e.dag = s.dag and e.step = s.step and coalesce(d.status, '') <> 'COMPLETED')")
def dag_ready(part: DataFrame) -> DataFrame:
    return graph.ready(_steps(part))


_RECURSIVE = _STEPS.replace("with s as", "with recursive s as").rstrip() + ", r as (select dag, step, 0 l from steps where len(deps) = 0 union all select e.dag, e.step, r.l + 1 from r join e on e.dag = r.dag and e.dep = r.step) "


@query("part", _RECURSIVE + "select dag, step, cast(max(l) as bigint) as level from r group by 1, 2")
def dag_topo_level(part: DataFrame) -> DataFrame:
    return graph.levels(_steps(part))


@query("part", _STEPS + "select dag, step, string_agg(o, ',' order by p) inputs from (select dag, step, o, min(p) p from (select e.dag, e.step, unnest(d.outputs) o, e.place * 10 + generate_subscripts(d.outputs, 1) p from e join steps d on d.dag = e.dag and d.step = e.dep) group by 1, 2, 3) group by 1, 2")
def dag_fan_in(part: DataFrame) -> DataFrame:
    return graph.fan_in(_steps(part)).select("dag", "step", F.array_join("inputs", ",").alias("inputs"))


@query("part", _STEPS + "select dag, count(*) total, count(*) filter (status = 'COMPLETED') completed, count(*) filter (status = 'FAILED') failed, case when count(*) filter (status = 'PENDING') > 0 then 'PROCESSING' when count(*) filter (status = 'FAILED') > 0 then 'FAILED' else 'COMPLETED' end status from steps group by 1")
def dag_completion(part: DataFrame) -> DataFrame:
    return graph.completion(_steps(part))


@query("part", _STEPS + "select dag, step, case when status = 'PENDING' and exists (select 1 from steps f where f.dag = s.dag and f.status = 'FAILED') then 'CANCELLED' else status end status from steps s")
def dag_fail_fast(part: DataFrame) -> DataFrame:
    return graph.fail_fast(_steps(part))


@query("part", _STEPS + "select dag, string_agg(o, ',' order by step, k) outputs from (select dag, step, unnest(outputs) o, generate_subscripts(outputs, 1) k from steps s where not exists (select 1 from e where e.dag = s.dag and e.dep = s.step)) group by 1")
def leaf_outputs(part: DataFrame) -> DataFrame:
    return graph.leaf_outputs(_steps(part)).select("dag", F.array_join("outputs", ",").alias("outputs"))


#: The steps with faults: some wait for steps that aren't there, some for later ones, some come twice, some for each other.
_FAULTY = (
    _STEPS.replace("with s as", "with recursive s as").replace("steps as (select *, list_sort(deps0) deps from t)", """faulty as (select dag, step, deps0 || (case when p_size = 3 then [77] else [] end) || (case when dag % 7 = 3 and step = 1 then [9] when dag % 11 = 5 and step = 0 then [5] else [] end) deps from t),
     steps as (select * from faulty union all select f.* from faulty f join t on t.dag = f.dag and t.step = f.step where p_size = 9)""").rstrip()
    + ", l as (select distinct e.dag, e.step, dep from e where exists (select 1 from t where t.dag = e.dag and t.step = e.dep)), reach as (select dag, step, dep from l union select r.dag, r.step, l.dep from reach r join l on l.dag = r.dag and l.step = r.dep) "
)


def _faulty(part: DataFrame) -> DataFrame:
    none = F.array().cast("array<long>")
    long_ = lambda n: F.array(F.lit(n).cast("long"))
    late = F.when((F.col("dag") % 7 == 3) & (F.col("step") == 1), long_(9)).when((F.col("dag") % 11 == 5) & (F.col("step") == 0), long_(5)).otherwise(none)
    sized = part.select(F.expr("p_partkey div 10").alias("dag"), (F.col("p_partkey") % 10).alias("step"), "p_size")
    steps = _steps(part).join(sized, ["dag", "step"]).withColumn("deps", F.concat("deps", F.when(F.col("p_size") == 3, long_(77)).otherwise(none), late))
    return steps.unionByName(steps.filter("p_size = 9")).drop("p_size")


@query("part", _FAULTY + "select dag, 'no root' problem from steps group by 1 having count(*) filter (len(deps) = 0) = 0 union all select distinct e.dag, 'missing' from e left join t on t.dag = e.dag and t.step = e.dep where t.step is null union all select distinct dag, 'duplicate' from (select dag, step from steps group by 1, 2 having count(*) > 1) union all select distinct dag, 'cycle' from reach where step = dep")
def dag_validate(part: DataFrame) -> DataFrame:
    return graph.problems(_faulty(part))
