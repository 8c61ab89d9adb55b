"""The library's queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.operators import chat, ordered, store

from .registry import QUERIES, SQL, Query, joined, query, table

GIFTS = ", ".join(f"'{k}'" for k in chat.GIFT_KINDS)
HOUR_US = 3_600_000_000


@query("events", f"select count(*) total, count(*) filter (event_type in ({GIFTS})) gifts, count(*) filter (event_type not in ({GIFTS})) chats, count(distinct user_id) senders, cast((max(epoch_us(ts)) - arg_min(epoch_us(ts), event_id)) // 1000000 as bigint) duration_s from events")
def chat_totals(events: DataFrame) -> DataFrame:
    return chat.totals(chat.messages(events))


@query("events", "select epoch_us(ts) // 10000000 * 10 bucket_s, count(*) n from events group by 1")
def chat_rate_10s(events: DataFrame) -> DataFrame:
    return chat.rate(chat.messages(events), 10)


@query("events", "select epoch_us(ts) // 60000000 * 60 bucket_s, count(*) n from events group by 1")
def chat_rate_per_minute(events: DataFrame) -> DataFrame:
    return chat.rate(chat.messages(events), 60)


@query(
    "events",
    "with r as (select epoch_us(ts) // 600000000 * 600 b, count(*) n from events group by 1) "
    "select s.b bucket_s, coalesce(r.n, 0) n from (select unnest(generate_series((select min(b) from r), (select max(b) from r), 600)) b) s left join r on s.b = r.b",
)
def rate_gap_filled(events: DataFrame) -> DataFrame:
    return chat.rate_gap_filled(chat.messages(events), 600)


@query("events", "with r as (select epoch_us(ts) // 60000000 * 60 b, count(*) n from events group by 1) select b // 3600 part, max(n) n, arg_max(b, n * 1000000000000 - b) bucket_s from r group by 1")
def rate_downsample_peak(events: DataFrame) -> DataFrame:
    return chat.rate_peak_by(chat.messages(events), 60, 60)


@query("events", "select user_id, count(*) n from events group by 1 order by n desc, user_id limit 20")
def chat_top_talkers(events: DataFrame) -> DataFrame:
    return chat.top(chat.talkers(chat.messages(events)), "user_id", 20)


@query("events", f"select user_id, cast(sum(greatest(coalesce(cast(props->>'$.k' as bigint), 1), 1)) as bigint) n from events where event_type in ({GIFTS}) group by 1 order by n desc, user_id limit 20")
def chat_top_gifters(events: DataFrame) -> DataFrame:
    return chat.top(chat.gifters(chat.messages(events)), "user_id", 20)


@query("events", f"select event_type kind, count(*) gifts, cast(sum(greatest(coalesce(cast(props->>'$.k' as bigint), 1), 1)) as bigint) n from events where event_type in ({GIFTS}) group by 1")
def chat_gift_tally(events: DataFrame) -> DataFrame:
    return chat.gift_tally(chat.messages(events))


@query("events", "select event_type kind, count(distinct user_id) senders from events group by 1")
def chat_distinct_exact(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("event_type").alias("kind")).agg(F.countDistinct("user_id").alias("senders"))


@query("events", "select user_id, arg_max(event_type, event_id) latest from events group by 1")
def latest_per_key(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("latest"))


_SUMMARY_SQL = """
with u as (select event_type kind, user_id, count(*) n from events group by 1, 2),
     b as (select event_type kind, epoch_us(ts) // 3600000000 h, count(*) n from events group by 1, 2)
select u.kind, cast(sum(u.n) as bigint) total, count(*) senders, arg_max(u.user_id, u.n * 1000000000 - u.user_id) top_talker, max(u.n) top_count,
       (select max(b.n) from b where b.kind = u.kind) peak
from u group by u.kind"""


@query("events", _SUMMARY_SQL)
def chat_session_summary(events: DataFrame) -> DataFrame:
    return chat.session_summary(chat.messages(events))


_STOP = ", ".join(f"'{w}'" for w in chat.STOP_WORDS)
_UNICODE_WORD = "select {by} lower(w) word from (select {by} unnest(regexp_split_to_array(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]+')) w from documents) where length(w) >= 2"



@query("documents", f"select word, count(*) n from ({_UNICODE_WORD.format(by='')}) where word not in ({_STOP}) group by 1 order by n desc, word limit 50")
def word_frequency(docs: DataFrame) -> DataFrame:
    return chat.top(chat.unicode_words(docs), "word", 50)


@query("documents", f"select lang, word, n from (select *, row_number() over (partition by lang order by n desc, word) p from (select lang, word, count(*) n from ({_UNICODE_WORD.format(by='lang,')}) where word not in ({_STOP}) group by 1, 2)) where p <= 20")
def word_frequency_by_lang(docs: DataFrame) -> DataFrame:
    return store.keep_newest(chat.unicode_words(docs, "lang"), "lang", [F.desc("n"), F.col("word")], 20).drop("place")


@query("orders", "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'O' and o_totalprice > 1000 order by o_totalprice desc, o_orderkey limit 50 offset 50")
def filter_conjunctive_page(orders: DataFrame) -> DataFrame:
    found = orders.filter((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 1000)).select("o_orderkey", "o_custkey", "o_totalprice")
    return store.page(found, [F.desc("o_totalprice"), F.col("o_orderkey")], 50, 50)


@query("part", "select p_partkey, p_name from part where contains(lower(p_name), 'a') and p_size > 10")
def search_like(part: DataFrame) -> DataFrame:
    return part.filter(F.lower("p_name").contains("a") & (F.col("p_size") > 10)).select("p_partkey", "p_name")


@query("orders", "select count(*) filter (o_orderstatus = 'O') n_o, count(*) filter (o_orderstatus = 'F') n_f, count(*) filter (o_orderstatus = 'P') n_p from orders")
def status_pivot(orders: DataFrame) -> DataFrame:
    return store.status_pivot(orders, "o_orderstatus", ("O", "F", "P"))


@query("orders", "select o_orderstatus, count(*) n from orders group by 1")
def status_group_count(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("lineitem", "select l_orderkey, cast(max(l_linenumber) + 1 as bigint) next_index from lineitem group by 1")
def next_index(lineitem: DataFrame) -> DataFrame:
    return store.next_index(lineitem, "l_orderkey", "l_linenumber")


@query("part", "select distinct p_brand from part where p_brand is not null")
def distinct_category(part: DataFrame) -> DataFrame:
    return part.select("p_brand").filter("p_brand is not null").distinct()


@query("orders", "select o_custkey, o_orderkey, cast(p as bigint) place from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) p from orders) where p <= 3")
def keep_newest_k(orders: DataFrame) -> DataFrame:
    kept = store.keep_newest(orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)
    return kept.select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@joined("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(live, "c_custkey", "left_semi")


@joined("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def anti_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")


@joined("select c_custkey, coalesce(case when c_acctbal > 5000 then c_mktsegment end, case when n_nationkey % 2 = 0 then n_name end, r_name) setting from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def config_override_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    own, group = F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))
    return rows.select("c_custkey", F.coalesce(own, group, F.col("r_name")).alias("setting"))


@query(
    "events",
    f"with d as (select user_id, event_id, epoch_us(ts) us, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by epoch_us(ts), event_id) gap from events), "
    f"s as (select *, sum(case when gap > {HOUR_US} then 1 else 0 end) over (partition by user_id order by us, event_id rows unbounded preceding) session from d) "
    "select user_id, cast(session as bigint) as session, count(*) n, min(us) start_us, max(us) end_us from s group by 1, 2",
)
def session_gap(events: DataFrame) -> DataFrame:
    rows = ordered.sessions(chat.messages(events).select("user_id", "seq", "us"), "user_id", "us", "seq", HOUR_US)
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


@query("events", "select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) p from events) where p is null or p <> event_type")
def title_changes(events: DataFrame) -> DataFrame:
    return ordered.without_repeats(events.select("user_id", "event_id", "event_type"), "user_id", [F.col("event_id")], "event_type")


@query("events", "select user_id, event_id as after, f - event_id - 1 missing from (select user_id, event_id, lead(event_id) over (partition by user_id order by event_id) f from events) where f - event_id - 1 > 0")
def gap_detect(events: DataFrame) -> DataFrame:
    return ordered.gaps(events, "user_id", "event_id")


@query("events", f"select user_id, event_id, count(*) over (partition by user_id order by epoch_us(ts) range between {HOUR_US} preceding and current row) failures from events where event_type = 'error'")
def rolling_failures(events: DataFrame) -> DataFrame:
    rows = chat.messages(events).filter("kind = 'error'")
    return rows.select("user_id", F.col("seq").alias("event_id"), ordered.rolling_count(rows, "user_id", "us", HOUR_US).alias("failures"))


from . import files, graph, machines, operations, predicates, relational, repair, rolling, scalars, schedules, streams  # noqa: E402, F401  they register theirs


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
