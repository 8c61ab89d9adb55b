"""Lookups, joins, retention and writes of the operational store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.operators import filters, store

from .registry import joined, query, table


@query("orders", "select o_orderkey from orders where o_orderstatus in ('O', 'P') and o_orderdate >= timestamp '1995-01-01' and o_totalprice > 1000 and (contains(lower(o_orderpriority), 'urgent') or contains(lower(o_orderstatus), 'urgent'))")
def job_filter(orders: DataFrame) -> DataFrame:
    wanted = filters.conjunction(filters.one_of("o_orderstatus", ["O", "P"]), filters.between("o_orderdate", F.lit("1995-01-01").cast("timestamp_ntz")), F.col("o_totalprice") > 1000, filters.search("URGENT", "o_orderpriority", "o_orderstatus"), filters.one_of("o_custkey", None))
    return orders.filter(wanted).select("o_orderkey")


@query("orders", "select o_orderkey, o_orderstatus from orders where o_totalprice > 100000 or o_orderstatus = 'O'")
def session_filter(orders: DataFrame) -> DataFrame:
    return orders.filter((F.col("o_totalprice") > 100000) | (F.col("o_orderstatus") == "O")).select("o_orderkey", "o_orderstatus")


@joined("select event_id, c_name from events left join customer on user_id = c_custkey where (contains(lower(event_type), 'err') or contains(lower(c_name), 'err')) and value >= 1 order by event_id desc limit 1000")
def event_log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, names = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    found = events.select("event_id", "user_id", "event_type", "value").join(names, "user_id", "left").filter(filters.search("ERR", "event_type", "c_name") & (F.col("value") >= 1))
    return store.page(found, [F.desc("event_id")], filters.clamped(5000)).select("event_id", "c_name")


@query("supplier", "select s_suppkey from supplier where s_nationkey not in (1, 2, 3) and (s_acctbal is null or s_acctbal < 5000)")
def active_streamers(supplier: DataFrame) -> DataFrame:
    return supplier.filter(~F.col("s_nationkey").isin(1, 2, 3) & (F.col("s_acctbal").isNull() | (F.col("s_acctbal") < 5000))).select("s_suppkey")


@query("customer", "select c_custkey from customer where upper(c_mktsegment) in ('BUILDING', 'MACHINERY') and contains(lower(c_name), '1')")
def streamer_list(customer: DataFrame) -> DataFrame:
    states = F.transform(F.split(F.lit(" building,, Machinery "), ","), lambda s: F.upper(F.trim(s)))
    return customer.filter(F.array_contains(states, F.upper("c_mktsegment")) & filters.search("1", "c_name")).select("c_custkey")


@joined("select l_orderkey, l_linenumber from lineitem where (l_orderkey, l_suppkey) in (select o_orderkey, o_custkey % 100 + 1 from orders)")
def tuple_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 100 + 1).alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").join(pairs, ["l_orderkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query("lineitem", "select l_returnflag, avg(coalesce(case when l_linenumber % 2 = 1 then l_quantity end, l_linenumber * 10)) mean, avg(case when l_quantity > 1000 then l_quantity end) none from lineitem group by 1")
def avg_with_fallback(lineitem: DataFrame) -> DataFrame:
    own = F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity"))
    return lineitem.groupBy("l_returnflag").agg(F.avg(F.coalesce(own, F.col("l_linenumber") * 10)).alias("mean"), F.avg(F.when(F.col("l_quantity") > 1000, F.col("l_quantity"))).alias("none"))


@query("orders", "select o_orderkey, (select count(*) from orders where o_orderstatus = 'F') total from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 20 offset 40")
def page_with_total(orders: DataFrame) -> DataFrame:
    found = orders.filter("o_orderstatus = 'F'")
    return store.page_with_total(found.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 40).select("o_orderkey", "total")


@joined("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
def inner_join_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(some, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@joined("select o_orderkey, c_name from orders left join customer on o_custkey = c_custkey where contains(lower(c_name), '99') or contains(lower(o_orderpriority), 'low')")
def left_join_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(names, "o_custkey", "left").filter(filters.search("99", "c_name") | filters.search("low", "o_orderpriority")).select("o_orderkey", "c_name")


@joined("select p_partkey from part where p_size > 10 and not exists (select 1 from lineitem join orders on o_orderkey = l_orderkey where l_partkey = p_partkey and (o_orderstatus not in ('F', 'O', 'P') or o_totalprice >= 490000))")
def prunable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").filter("o_orderstatus not in ('F', 'O', 'P') or o_totalprice >= 490000").select(F.col("o_orderkey").alias("l_orderkey"))
    used = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(held, "l_orderkey").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").filter("p_size > 10").select("p_partkey").join(used, "p_partkey", "left_anti")


@joined(
    "select c_custkey from customer where c_acctbal > 0 and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') and not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000) "
    "and not exists (select 1 from supplier where s_nationkey = c_nationkey and s_acctbal < -900) and not exists (select 1 from events where user_id = c_custkey and event_type = 'error')"
)
def anti_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, left = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_nationkey")
    by_customer = [orders.filter("o_orderstatus = 'P'").select("o_custkey"), orders.filter("o_totalprice > 450000").select("o_custkey"), table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id")]
    for some in by_customer:
        left = left.join(some.toDF("c_custkey"), "c_custkey", "left_anti")
    nations = table(spark, sf_dir, "supplier").filter("s_acctbal < -900").select(F.col("s_nationkey").alias("c_nationkey"))
    return left.join(nations, "c_nationkey", "left_anti").select("c_custkey")


@joined("select c_custkey, coalesce((select cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) from orders where o_custkey = c_custkey and o_orderstatus = 'P'), 0) cents from customer")
def scalar_sum_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(sums, "c_custkey", "left").select("c_custkey", F.coalesce("cents", F.lit(0)).cast("long").alias("cents"))


@joined("select s_suppkey, coalesce(case when s_acctbal > 0 then s_name end, (select n_name from nation where n_nationkey = s_nationkey)) label from supplier")
def backfill_one_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf_dir, "supplier").join(names, "s_nationkey", "left").select("s_suppkey", F.coalesce(F.when(F.col("s_acctbal") > 0, F.col("s_name")), "n_name").alias("label"))


@joined("select o_orderkey, coalesce(string_agg(cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey), '') parts from orders left join lineitem on o_orderkey = l_orderkey group by 1")
def collected_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_partkey").cast("string").alias("p")))).alias("rows"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(parts, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.array_join(F.col("rows.p"), ","), F.lit("")).alias("parts"))


@joined(
    "select c_custkey, coalesce((select min(s_suppkey) from supplier where s_nationkey = c_nationkey and cast(floor(s_acctbal / 1000) as bigint) = cast(floor(c_acctbal / 1000) as bigint)), (select min(s_suppkey) from supplier where s_nationkey = c_nationkey)) supplier from customer"
)
def lookup_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = lambda c: F.floor(F.col(c) / 1000).alias("band")
    of = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), band("s_acctbal"), "s_suppkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), band("c_acctbal"))
    exact, near = of.groupBy("nation", "band").agg(F.min("s_suppkey").alias("exact")), of.groupBy("nation").agg(F.min("s_suppkey").alias("near"))
    return rows.join(exact, ["nation", "band"], "left").join(near, "nation", "left").select("c_custkey", F.coalesce("exact", "near").alias("supplier"))


@query("orders", "select o_orderkey from orders where o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F' order by o_orderdate, o_orderkey limit 500)")
def prune_batch(orders: DataFrame) -> DataFrame:
    old = orders.select("o_orderkey", "o_orderdate", "o_orderstatus")
    batch = old.filter("o_orderstatus = 'F'").orderBy("o_orderdate", "o_orderkey").limit(500).select("o_orderkey")
    return old.join(batch, "o_orderkey", "left_anti").select("o_orderkey")


@query("orders", "select o_orderkey from orders where o_orderkey not in (select o_orderkey from orders order by o_orderdate, o_orderkey limit 300)")
def ring_buffer_trim(orders: DataFrame) -> DataFrame:
    return store.without_oldest(orders.select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], 300, "o_orderkey").select("o_orderkey")


@query("orders", "select o_orderkey from orders where o_orderstatus = 'O' order by o_orderpriority, o_orderdate desc, o_orderkey desc limit 1")
def claim_next(orders: DataFrame) -> DataFrame:
    return orders.filter("o_orderstatus = 'O'").orderBy("o_orderpriority", F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey")


@query("orders", "select o_orderkey, cast(case o_orderstatus when 'O' then 0 when 'P' then 1 else 2 end as bigint) rank from orders order by rank, o_totalprice desc, o_orderkey limit 100")
def state_order(orders: DataFrame) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2).cast("long").alias("rank")
    return store.page(orders.select("o_orderkey", "o_totalprice", rank), [F.col("rank"), F.desc("o_totalprice"), F.col("o_orderkey")], 100).select("o_orderkey", "rank")


@query("events", "select event_id from events order by case event_type when 'signup' then 0 when 'view' then 1 else 2 end, user_id, event_id limit 200")
def fetch_order(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    return store.page(events.select("event_id", "user_id", "event_type"), [kind, F.col("user_id"), F.col("event_id")], 200).select("event_id")


@query("events", "select event_id, row_number() over (order by event_id) place from (select event_id from events order by event_id desc limit 200)")
def newest_oldest_first(events: DataFrame) -> DataFrame:
    newest = store.page(events.select("event_id"), [F.desc("event_id")], 200)
    return newest.withColumn("place", F.row_number().over(Window.orderBy("event_id")).cast("long"))


@query("events", "select user_id, arg_max(event_type, event_id) kind, arg_max(value, event_id) as value from events group by 1")
def upsert_replace(events: DataFrame) -> DataFrame:
    return store.replace_all(events, "user_id", "event_id", "event_type", "value").withColumnRenamed("event_type", "kind")


@query("events", "select user_id, arg_max(event_id, event_id) filter (event_type = 'purchase') bought, arg_max(event_id, event_id) filter (event_type = 'error') failed from events group by 1")
def upsert_coalesce(events: DataFrame) -> DataFrame:
    seen = events.select("user_id", "event_id", *[F.when(F.col("event_type") == k, F.col("event_id")).alias(c) for k, c in (("purchase", "bought"), ("error", "failed"))])
    return store.keep_last_set(seen, "user_id", "event_id", "bought", "failed")


@query("orders", "select o_orderkey, 'P' status from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT'")
def compare_and_set(orders: DataFrame) -> DataFrame:
    return orders.filter("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("P").alias("status"))


@query(
    "events",
    "with d as (select *, max(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) d, lag(event_type) over (partition by user_id order by event_id) p, row_number() over (partition by user_id order by event_id) n from events) "
    "select user_id, count(*) filter (coalesce(d, 0) = 0 and n > 1 and p <> event_type) generation, count(*) filter (coalesce(d, 0) = 0) refreshed, count(*) filter (d = 1) duplicates from d group by 1",
)
def keyed_ingest(events: DataFrame) -> DataFrame:
    return store.ingest(events, "user_id", "event_id", "event_type", F.col("event_type") == "purchase")


@query("supplier", "select s_suppkey, cast(coalesce(case when s_acctbal > 0 then s_nationkey end, 0) + 1 as bigint) failures from supplier")
def increment_coalesce(supplier: DataFrame) -> DataFrame:
    return supplier.select("s_suppkey", (F.coalesce(F.when(F.col("s_acctbal") > 0, F.col("s_nationkey")), F.lit(0)) + 1).cast("long").alias("failures"))


@joined("select c_custkey, coalesce(n_name, c_mktsegment) state from customer left join nation on c_nationkey = n_nationkey and n_regionkey = 1")
def batch_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(changes, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", "c_mktsegment").alias("state"))


@query("orders", "select o_orderkey, case when o_orderstatus = 'F' then 'O' else o_orderstatus end status, case when o_orderstatus = 'F' then null else o_totalprice end result from orders where o_orderstatus <> 'P'")
def retry_reset(orders: DataFrame) -> DataFrame:
    failed = F.col("o_orderstatus") == "F"
    return orders.filter("o_orderstatus <> 'P'").select("o_orderkey", F.when(failed, "O").otherwise(F.col("o_orderstatus")).alias("status"), F.when(~failed, F.col("o_totalprice")).alias("result"))


@query("orders", "select o_orderkey, o_orderkey = max(o_orderkey) over (partition by o_custkey) live from orders where o_orderstatus = 'O'")
def stale_live_cleanup(orders: DataFrame) -> DataFrame:
    live = orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    newest = live.groupBy("o_custkey").agg(F.max("o_orderkey").alias("newest"))
    return live.join(newest, "o_custkey").select("o_orderkey", (F.col("o_orderkey") == F.col("newest")).alias("live"))


@query("orders", "select o_orderkey, cast(case substr(o_orderpriority, 1, 1) when '1' then 10 when '2' then 5 else 0 end as bigint) priority from orders")
def priority_migration(orders: DataFrame) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    return orders.select("o_orderkey", F.when(first == "1", 10).when(first == "2", 5).otherwise(0).cast("long").alias("priority"))


@joined("select c_custkey, case when n_regionkey <> 2 then c_nationkey end nation from customer left join nation on c_nationkey = n_nationkey where coalesce(n_regionkey, -1) <> 3")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rows below region 3 go; references to what is below region 2 become null
    below = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    left = rows.join(below.filter("n_regionkey = 3"), "c_nationkey", "left_anti").join(below, "c_nationkey", "left")
    return left.select("c_custkey", F.when(F.col("n_regionkey") != 2, F.col("c_nationkey")).alias("nation"))


@query("customer", "select c_nationkey, max(case when c_acctbal < -500 then 2 when c_acctbal < 0 then 1 else 0 end) worst from customer group by 1")
def health_roll_up(customer: DataFrame) -> DataFrame:
    level = F.when(F.col("c_acctbal") < -500, 2).when(F.col("c_acctbal") < 0, 1).otherwise(0)
    return customer.groupBy("c_nationkey").agg(F.max(level).alias("worst"))


@query("events", "select event_type kind, count(*) n, cast(sum(event_id) as double) / count(*) mean from events group by 1")
def labelled_counters(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), (F.sum("event_id").cast("double") / F.count("*")).alias("mean"))


@query("lineitem", "select l_orderkey, count(*) n, min(l_linenumber) first_part, max(l_shipdate) last_end, cast(sum(l_quantity) as bigint) size, min(l_shipdate) first_end from lineitem group by 1")
def timeline_groups(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first_part"), F.max("l_shipdate").alias("last_end"), F.sum("l_quantity").cast("long").alias("size"), F.min("l_shipdate").alias("first_end"))


@joined("select distinct a.user_id, epoch_us(a.ts) // 3600000000 as \"hour\" from events a join events b on a.user_id = b.user_id and epoch_us(a.ts) // 3600000000 = epoch_us(b.ts) // 3600000000 where a.event_type = 'view' and b.event_type = 'click'")
def paired_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rillwork.operators.chat import messages

    rows = messages(table(spark, sf_dir, "events")).withColumn("hour", F.expr("us div 3600000000"))
    both = rows.groupBy("user_id", "hour").agg(F.max((F.col("kind") == "view").cast("int")).alias("video"), F.max((F.col("kind") == "click").cast("int")).alias("chat"))
    return both.filter("video = 1 and chat = 1").select("user_id", "hour")
