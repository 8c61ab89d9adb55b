"""Schedules, content filters and candidate ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.operators import filters

from .registry import query

_SECOND = "(hour(ts) * 3600 + minute(ts) * 60 + second(ts))"


@query("events", f"select event_id from events where dayofweek(ts) in (1, 2, 3) and {_SECOND} >= 32400 and {_SECOND} < 61200")
def filter_time_window(events: DataFrame) -> DataFrame:
    return events.filter(filters.in_schedule(F.col("ts"), ("Mon", "Tue", "Wed"), "09:00", "17:00")).select("event_id")


@query("events", f"select event_id from events where case when dayofweek(ts) in (5, 6) then {_SECOND} >= 79200 or {_SECOND} < 7200 else dayofweek(ts) in (6, 0) and {_SECOND} < 7200 end")
def filter_time_overnight(events: DataFrame) -> DataFrame:
    return events.filter(filters.in_schedule(F.col("ts"), ("Fri", "Sat"), "22:00", "02:00")).select("event_id")


@query("events", "select event_id, (select min(o) from (select date_trunc('day', ts) + to_days(cast(d as integer)) + interval 9 hour o from generate_series(0, 7) g(d)) where o > ts and dayofweek(o) in (1, 3)) opens from events")
def next_match_time(events: DataFrame) -> DataFrame:
    return events.select("event_id", filters.next_match(F.col("ts"), ("Mon", "Wed"), "09:00").alias("opens"))


@query("events", "select event_id from events where minute(ts) % 15 = 0 and hour(ts) between 8 and 20 and dayofweek(ts) in (0, 1, 2, 3, 4)")
def filter_cron(events: DataFrame) -> DataFrame:
    return events.filter(filters.in_cron(F.col("ts"), "*/15 8-20 * * 1-4,7")).select("event_id")


@query("documents", "select doc_id from documents where not contains(lower(coalesce(text, '')), 'copyright') and (contains(lower(text), 'stream') or contains(lower(text), 'license') or contains(lower(text), 'tion'))")
def filter_keyword(docs: DataFrame) -> DataFrame:
    return docs.filter(filters.keywords_match(F.col("text"), ("Stream", "LICENSE", "tion"), ("Copyright",))).select("doc_id")


@query("customer", "select c_custkey from customer where lower(c_mktsegment) in ('building', 'furniture')")
def filter_category(customer: DataFrame) -> DataFrame:
    return customer.filter(filters.category_matches(F.col("c_mktsegment"), ("Building", "FURNITURE"))).select("c_custkey")


@query("part", "select p_partkey from part where not regexp_matches(p_type, '(?i)steel|^small')")
def filter_regex_xor(part: DataFrame) -> DataFrame:
    return part.filter(filters.regex_matches(F.col("p_type"), "steel|^small", exclude=True)).select("p_partkey")


@query("part", "select p_partkey, case when not contains(lower(p_name), 'a') then 'keyword' when not regexp_matches(p_type, '(?i)steel|brass|tin') then 'regex' when p_size < 10 then 'size' end reason from part")
def filter_reason_chain(part: DataFrame) -> DataFrame:
    reason = filters.first_reason(("keyword", filters.keywords_match(F.col("p_name"), ("a",))), ("regex", filters.regex_matches(F.col("p_type"), "steel|brass|tin")), ("size", F.col("p_size") >= 10))
    return part.select("p_partkey", reason.alias("reason"))


_RANK = """
with c as (select l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipmode, case when contains(l_shipmode, 'r') then 0 when contains(l_shipmode, 'a') then 1 else 2 end pref from (select *, lower(l_returnflag) l_shipmode from lineitem) where l_linestatus <> 'X' and l_suppkey % 10 <> 0),
     f as (select *, l_quantity >= 20 fits, bool_or(l_quantity >= 20) over (partition by l_orderkey) any_fit from c)
select l_orderkey, l_linenumber, place from (select *, row_number() over (partition by l_orderkey order by pref, l_quantity desc, l_linenumber, l_partkey) place from f where fits or not any_fit) {where}"""


def _candidates(lineitem: DataFrame) -> DataFrame:
    order = [filters.preference(F.col("l_returnflag"), ("r", "a")), F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")]
    return filters.ranked_candidates(lineitem, "l_orderkey", F.col("l_suppkey") % 10 == 0, F.col("l_quantity") >= 20, order)


@query("lineitem", _RANK.format(where=""))
def candidate_rank(lineitem: DataFrame) -> DataFrame:
    return _candidates(lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")).select("l_orderkey", "l_linenumber", "place")


@query("lineitem", _RANK.format(where="where place = 1 and l_quantity < 20"))
def candidate_fallback(lineitem: DataFrame) -> DataFrame:
    found = _candidates(lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"))
    return found.filter("place = 1 and l_quantity < 20").select("l_orderkey", "l_linenumber", "place")


@query("lineitem", "select l_orderkey, arg_min(n, (-b, n)) highest, arg_min(n, (b, n)) lowest, arg_min(n, (abs(b - 50000), n)) closest from (select l_orderkey, l_linenumber n, cast(l_extendedprice as bigint) // 1000 * 1000 b from lineitem) group by 1")
def hls_variant_choice(lineitem: DataFrame) -> DataFrame:
    rate = F.expr("cast(round(l_extendedprice) as bigint) div 1000 * 1000")
    return filters.variant_choice(lineitem.select("l_orderkey", "l_linenumber", rate.alias("rate")), "l_orderkey", "l_linenumber", "rate", 50_000)
