"""More queries of the store: pages with totals, tokens, the outbox, timelines, layered settings, and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.functions import urls
from rillwork.operators import repair, rolling, store

from .registry import joined, query, table

_NOW = 1_705_795_200_000_000


@joined("with f as (select l_orderkey, l_linenumber, l_partkey from lineitem where l_returnflag = 'R' and l_orderkey in (select o_orderkey from orders where o_custkey % 10 = 3)) select l_orderkey, l_linenumber, l_partkey, (select count(*) from f) total from f order by l_orderkey desc, l_linenumber, l_partkey limit 40 offset 20")
def output_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    found = store.outputs_page(outputs, sessions, "l_orderkey", [F.desc("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 40, 20, of_streamer=F.col("o_custkey") % 10 == 3, search=F.col("l_returnflag") == "R")
    return found.drop("l_returnflag")


@query("events", f"select event_id, user_id from events where event_type <> 'error' and epoch_us(ts) + cast(props->>'$.k' as bigint) * 3600000000 > {_NOW}")
def active_tokens(events: DataFrame) -> DataFrame:
    us = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col("ts").cast("timestamp_ntz"))
    tokens = events.select("event_id", "user_id", us.alias("us"), F.when(F.col("event_type") == "error", us).alias("revoked"), (us + F.get_json_object("props", "$.k").cast("long") * 3_600_000_000).alias("expires"))
    return store.active(tokens, "revoked", "expires", _NOW, [F.desc("us"), F.col("event_id")]).select("event_id", "user_id")


_OUTBOX = "with o as (select o_orderkey id, o_custkey % 4 attempts, case when o_orderstatus = 'F' then 'old' end last_error, case when o_custkey % 3 = 0 then o_custkey end delivered_at from orders), b as (select id from o where delivered_at is null order by id limit 500) "


@query("orders", _OUTBOX + "select id, case when id in (select id from b) then attempts + 1 else attempts end attempts, case when id in (select id from b) then case when id % 5 = 0 then 'refused' end else last_error end last_error, case when id in (select id from b) and id % 5 <> 0 then 77 else delivered_at end delivered_at from o")
def outbox_delivery(orders: DataFrame) -> DataFrame:
    """A pass over the first 500 entries; every fifth fails."""
    cust = F.col("o_custkey")
    outbox = orders.select(F.col("o_orderkey").alias("id"), (cust % 4).alias("attempts"), F.when(F.col("o_orderstatus") == "F", "old").alias("last_error"), F.when(cust % 3 == 0, cust).alias("delivered_at"))
    batch = store.undelivered(outbox, "id", "delivered_at", 500)
    results = batch.select("id", F.when(F.col("id") % 5 == 0, "refused").alias("error"))
    return store.after_delivery(outbox, results, "id", F.lit(77).cast("long"))


@query("events", "with e as (select user_id, event_id, epoch_us(ts) us, cast(props->>'$.k' as bigint) k, case when event_type in ('error', 'signup') then event_type end reason from events) select user_id, count(*) n, min(us) first_start, max(us + k * 1000) last_end, max(k * 1000) longest, arg_min(reason, event_id) filter (reason is not null) first_reason from e group by 1")
def timelines(events: DataFrame) -> DataFrame:
    us = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col("ts").cast("timestamp_ntz"))
    parts = events.select("user_id", "event_id", us.alias("starts"), (us + F.get_json_object("props", "$.k").cast("long") * 1000).alias("ends"), F.when(F.col("event_type").isin("error", "signup"), F.col("event_type")).alias("reason"))
    return store.timeline(parts, "user_id", "event_id", "starts", "ends", "reason")


@joined(
    "with c as (select c_custkey, c_nationkey, case when c_custkey % 3 = 0 then c_custkey % 50 end size, case when c_custkey % 5 = 0 then 'own' end name from customer), "
    "n as (select n_nationkey, n_regionkey, case when n_nationkey % 2 = 0 then n_nationkey end size, case when n_nationkey % 4 = 1 then n_name end name from nation), "
    "r as (select r_regionkey, case when r_regionkey <> 2 then r_regionkey * 10 end size, case when r_regionkey < 3 then r_name end name from region) "
    "select c_custkey, greatest(coalesce(c.size, n.size, r.size, 60), 5) size, coalesce(c.name, n.name, r.name, 'global') as name from c join n on c_nationkey = n_nationkey join r on n_regionkey = r_regionkey"
)
def layered_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four layers: a customer's own settings, its nation's, its region's, and one for all; sizes are 5 at least."""
    nation, region, customer = (table(spark, sf_dir, n) for n in ("nation", "region", "customer"))
    key = F.col("c_custkey")
    own = customer.select("c_custkey", F.when(key % 3 == 0, key % 50).cast("long").alias("size"), F.when(key % 5 == 0, "own").alias("name"))
    of_nation = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).cast("long").alias("size"), F.when(F.col("n_nationkey") % 4 == 1, F.col("n_name")).alias("name"))
    of_region = region.select("r_regionkey", F.when(F.col("r_regionkey") != 2, F.col("r_regionkey") * 10).cast("long").alias("size"), F.when(F.col("r_regionkey") < 3, F.col("r_name")).alias("name"))
    of_all = spark.range(1).select(F.lit(1).alias("all"), F.lit(60).cast("long").alias("size"), F.lit("global").alias("name"))
    places = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    rows = customer.select("c_custkey", "c_nationkey").join(F.broadcast(places), "c_nationkey").withColumn("all", F.lit(1))
    return store.layered([(own, "c_custkey"), (of_nation, "c_nationkey"), (of_region, "r_regionkey"), (of_all, "all")], rows, {"size": 5, "name": None}).select("c_custkey", "size", "name")


@query("pages", "select page_id, 'https://h.example/p/q' || (page_id % 7) || '?z=1+2&b=%26' || (page_id % 3) || '&tok=9' url, 'https://h.example/p/q' || (page_id % 7) || '?b=%26' || (page_id % 3) || '&z=1+2' identity, 'https://h.example/p/s' || page_id || '.ts?a=1' resolved, 'https://h.example/p/s' || page_id || '.ts?a=1&tok=9' inherited from pages")
def url_identity(pages: DataFrame) -> DataFrame:
    n = lambda k: (F.col("page_id") % k).cast("string")
    url = F.concat(F.lit("https://h.example/p/q"), n(7), F.lit("?z=1+2&b=%26"), n(3), F.lit("&tok=9"))
    part = urls.resolved_url(url, F.concat(F.lit("./x/../s"), F.col("page_id").cast("string"), F.lit(".ts?a=1")))
    return pages.select("page_id", url.alias("url"), urls.identity_url(url, ("tok",)).alias("identity"), part.alias("resolved"), urls.inherited_query(part, F.lit("a=2&tok=9&tok=8")).alias("inherited"))


@query(
    "events",
    "with e as (select user_id, event_id, case event_type when 'view' then 'media' when 'click' then 'media' when 'purchase' then 'init' when 'error' then 'end' else 'ts' end k from events), "
    "a as (select *, case when k = 'ts' then 'ts' when k in ('init', 'media') then 'mp4' else k end lane from e), "
    "t as (select *, coalesce(lane <> lag(lane) over (partition by user_id order by event_id), true) or k = 'init' turn from a), "
    "g as (select *, sum(turn::int) over (partition by user_id order by event_id) gr, count(*) filter (k = 'init') over (partition by user_id order by event_id) inits from t), "
    "h as (select user_id, gr, count(*) n, arg_min(k, event_id) s from g group by 1, 2), f as (select *, lead(s) over (partition by user_id order by gr) follow from h) "
    "select g.user_id, event_id from g join f using (user_id, gr) where not (k in ('init', 'media') and coalesce(follow = 'init', false) and (s = 'init' and n < 3 or inits = 0))",
)
def hls_defragment(events: DataFrame) -> DataFrame:
    """Events as a playlist's items: purchases are inits, views and clicks media, errors ends, signups another kind of segment."""
    kind = F.expr("case event_type when 'view' then 'media' when 'click' then 'media' when 'purchase' then 'init' when 'error' then 'end' else 'ts' end")
    items = events.select("user_id", "event_id", kind.alias("kind"), F.lit(1).alias("size"))
    return repair.hls_defragmented(items, "user_id", "event_id", "kind", "size", 3).select("user_id", "event_id")


@query(
    "events",
    "with e as (select *, cast(props->>'$.k' as bigint) k, row_number() over (partition by user_id, event_type order by event_id) a from events), "
    "c as (select event_id, a, k, case k % 9 when 0 then '404' when 1 then '503' when 2 then '403' when 3 then '401' when 4 then 'network' when 5 then 'decode' when 6 then '418' when 7 then 'timeout' end kind, event_id % 2 = 0 changed from e), "
    "v as (select *, coalesce((kind in ('404', '503', 'network', 'decode', 'timeout') or kind in ('401', '403') and changed) and a < 12 and 250 * 2 ** least(a - 1, 16) <= 120000, false) retry from c) "
    "select event_id, case when retry then 'retry' else 'terminal' end verdict, case when retry then cast(250 * 2 ** least(a - 1, 16) as bigint) end wait_ms from v",
)
def retry_verdicts(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    attempt = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    kinds = ("404", "503", "403", "401", "network", "decode", "418", "timeout")
    failure = F.coalesce(*[F.when(k % 9 == i, F.lit(c)) for i, c in enumerate(kinds)])
    rows = events.select("event_id", failure.alias("kind"), attempt.alias("attempt"), (F.col("event_id") % 2 == 0).alias("changed"))
    return rows.select("event_id", rolling.retry_verdict(F.col("kind"), F.col("attempt"), F.col("changed"), 12, 250, 120_000).alias("v")).select("event_id", "v.verdict", "v.wait_ms")
