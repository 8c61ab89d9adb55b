"""Scalar functions and text sinks over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.functions import scalars as S
from rillwork.operators import chat

from .registry import query


@query("part", """select p_partkey, case when c = '' then 'unnamed' when regexp_matches(upper(c), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])([.]|$)') then '_' || c else c end filename
from (select p_partkey, regexp_replace(regexp_replace(case p_size % 4 when 0 then ' ..' || replace(p_name, ' ', '<>:|') || '. ' when 1 then 'con.' || p_name when 2 then '. .' else 'a/b\\' || p_name || '?' end, '[\x00-\x1f\x7f<>:"/\\\\|?*]+', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') c from part)""")
def sanitize_filename(part: DataFrame) -> DataFrame:
    kind, name = F.col("p_size") % 4, F.col("p_name")
    raw = F.when(kind == 0, F.concat(F.lit(" .."), F.replace(name, F.lit(" "), F.lit("<>:|")), F.lit(". "))).when(kind == 1, F.concat(F.lit("con."), name)).when(kind == 2, F.lit(". .")).otherwise(F.concat(F.lit("a/b\\"), name, F.lit("?")))
    return part.select("p_partkey", S.sanitized_filename(raw).alias("filename"))


@query("orders", """select o_orderkey, case when n >= 1073741824 then printf('%.2f GB', n / 1073741824.0::double) when n >= 1048576 then printf('%.2f MB', n / 1048576.0::double) when n >= 1024 then printf('%.2f KB', n / 1024.0::double) else n || ' B' end size from (select o_orderkey, o_custkey * case when o_orderkey % 3 = 0 then 1 when o_orderkey % 3 = 1 then 4096 else 8388608 end n from orders)""")
def format_bytes(orders: DataFrame) -> DataFrame:
    n = F.col("o_custkey") * F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 4096).otherwise(8_388_608)
    return orders.select("o_orderkey", S.size_text(n).alias("size"))


@query("orders", "select o_orderkey, printf('%d:%02d:%02d', o_custkey // 3600, o_custkey // 60 % 60, o_custkey % 60) duration from orders")
def format_duration(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", S.duration_text(F.col("o_custkey")).alias("duration"))


@query("pages", """with u as (select page_id, url || '?b=2&token=x&a=' || (page_id % 3) || case when page_id % 2 = 0 then '#f' else '' end u from pages) select page_id, split_part(split_part(u, '#', 1), '?', 1) || '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '[?]([^#]*)', 1), '&'), lambda x: x <> '' and split_part(x, '=', 1) <> 'token')), '&') canonical from u""")
def url_canonical(pages: DataFrame) -> DataFrame:
    url = F.concat("url", F.lit("?b=2&token=x&a="), (F.col("page_id") % 3).cast("string"), F.when(F.col("page_id") % 2 == 0, "#f").otherwise(""))
    return pages.select("page_id", S.canonical_url(url, ("token",)).alias("canonical"))


@query("events", """select event_id, '<d p="' || (epoch_us(ts) // 1000000) || ',1,25,' || (user_id % 16777216) || '">' || replace(replace(replace(props, '&', '&amp;'), '"', '&quot;'), '<', '&lt;') || '</d>' line from events""")
def danmu_xml_rows(events: DataFrame) -> DataFrame:
    at = F.call_function("div", chat.micros(F.col("ts")), F.lit(1_000_000)).cast("string")
    return events.select("event_id", F.concat(F.lit('<d p="'), at, F.lit(",1,25,"), (F.col("user_id") % 16_777_216).cast("string"), F.lit('">'), S.xml_escaped(F.col("props")), F.lit("</d>")).alias("line"))


@query("events", "select event_id, epoch_us(ts) // 1000000 at_s, props text from events")
def danmu_xml_roundtrip(events: DataFrame) -> DataFrame:
    line = F.col("line")
    return danmu_xml_rows(events).select("event_id", F.regexp_extract(line, r'p="(-?\d+),', 1).cast("long").alias("at_s"), S.xml_unescaped(F.regexp_extract(line, r"(?s)>(.*)</d>$", 1)).alias("text"))


@query("events", """select 'events_total{kind="' || event_type || '"} ' || count(*) line from events group by event_type""")
def prometheus_lines(events: DataFrame) -> DataFrame:
    n = events.groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select(S.metric_line("events_total", {"kind": F.col("event_type")}, F.col("n")).alias("line"))


@query("events", "select event_id from events where epoch_us(ts) // 1000 < 1705795200000 - 7 * 86400000")
def retention_cutoff(events: DataFrame) -> DataFrame:
    ms = F.call_function("div", chat.micros(F.col("ts")), F.lit(1000))
    return events.filter(ms < S.retention_cutoff(F.lit(1_705_795_200_000), 7)).select("event_id")


@query("part", """select p_partkey, case when p_size % 2 = 0 then cast(('0x' || printf('%06x', p_partkey)) as bigint) end color, case when length(p_name) > 8 then substr(p_name, 1, 8) || '...' else p_name end short, 'n' || p_partkey || '.FLV' base, 'flv' ext from part""")
def text_scalars(part: DataFrame) -> DataFrame:
    color = F.when(F.col("p_size") % 2 == 0, F.format_string("#%06x", "p_partkey")).otherwise("red")
    path = F.concat(F.lit("a\\b/n"), F.col("p_partkey").cast("string"), F.lit(".FLV"))
    return part.select("p_partkey", S.color_number(color).alias("color"), S.cut(F.col("p_name"), 8).alias("short"), S.base_name(path).alias("base"), S.extension(path).alias("ext"))


@query("part", """select p_partkey, cast(case when p_partkey % 2 = 0 then p_partkey * 1000 else (p_partkey + 1) * 1000000000000 end as bigint) ms, cast(ceil(1000.0 / p_size) as bigint) frame_ms, cast(greatest(1, trunc(p_size * 0.25)) as bigint) throttle, p_size * 100.0::double / 64 percent, cast(least((greatest(p_size, 1) + 1) * greatest(p_partkey, 1000), 300000) as bigint) window_ms, (p_partkey >> 7) & 15 rate_index, (p_partkey >> 3) & 15 channels, p_partkey * 300 + p_size pcr from part""")
def number_scalars(part: DataFrame) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    t = F.when(key % 2 == 0, key).otherwise((key + 1) * 1_000_000_000_000)
    return part.select(
        "p_partkey", S.as_millis(t).alias("ms"), S.frame_interval(size).alias("frame_ms"), S.throttled_limit(size, 0.25).alias("throttle"), S.progress(size, F.lit(64)).alias("percent"),
        S.hysteresis_window(size, key).alias("window_ms"), S.aac_rate_index(key).alias("rate_index"), S.aac_channels(key).alias("channels"), S.pcr_27mhz(key, size).alias("pcr"),
    )


@query("customer", "select c_custkey, c_mktsegment || '-' || c_name || '.flv' as filename from customer")
def placeholder_names(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", S.placeholders_filled(F.lit("{platform}-{streamer}.flv"), {"streamer": F.col("c_name"), "platform": F.col("c_mktsegment")}).alias("filename"))


@query("events", None)
def uid_crc32(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.crc32(F.col("user_id").cast("string").cast("binary")).alias("crc"))


@query("events", "select event_id, unnest(json_keys(props)) as part, props->>'$.k' as content from events")
def json_each(events: DataFrame) -> DataFrame:
    pairs = F.explode(F.from_json("props", "map<string,string>")).alias("part", "content")
    return events.select("event_id", pairs)


@query("events", """select event_id, case when user_id % 3 = 0 then 0 else cast(props->>'$.k' as bigint) end parsed from events""")
def json_or_default(events: DataFrame) -> DataFrame:
    broken = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("{oops"), "props")).otherwise(F.col("props"))
    return events.select("event_id", F.coalesce(F.from_json(broken, "k long")["k"], F.lit(0)).alias("parsed"))


@query("events", "select event_id, case when event_type = 'view' then 'live' when event_type = 'error' then 'broken' else 'idle' end state, case when event_type in ('error') then 'high' else 'low' end severity from events")
def enum_maps(events: DataFrame) -> DataFrame:
    named = lambda pairs: F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    state, severity = named({"view": "live", "error": "broken"}), named({"error": "high"})
    return events.select("event_id", F.coalesce(state[F.col("event_type")], F.lit("idle")).alias("state"), F.coalesce(severity[F.col("event_type")], F.lit("low")).alias("severity"))


@query("events", "select event_id, case when user_id % 2 = 0 then props->>'$.k' else '7' end k, case when user_id % 2 = 0 then 'base' else 'own' end origin from events")
def json_layers(events: DataFrame) -> DataFrame:
    base = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("origin"), F.lit("base")))
    own = F.when(F.col("user_id") % 2 == 1, F.create_map(F.lit("k"), F.lit("7"), F.lit("origin"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)
    return events.select("event_id", merged["k"].alias("k"), merged["origin"].alias("origin"))
