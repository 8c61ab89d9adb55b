"""Queries over the whole training-data tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import chat_digests
from .decontamination import decontaminate
from .hard_negatives import hard_negatives
from .jaccard_join import jaccard_components
from .mixing import mix
from .quality_classifier import classify_quality
from .quality_rules import quality_rules
from .sharding import shard_manifest
from .substring_dedup import remove_repeats
from .token_alignment import align
from .token_count import count_tokens
from .toxicity import classify_toxicity
from .warc import archive_and_read


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), 4, 85)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digests(_table(spark, sf_dir, "conversations"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_manifest(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_classifier,
        op2_quality_rules,
        op3_jaccard_join,
        op4_chat_formatting,
        op5_decontamination,
        op6_token_counts,
        op7_sharding,
        op8_substring_dedup,
        op9_mixing,
        op10_toxicity,
        op11_token_alignment,
        op12_hard_negatives,
        op13_warc,
    )
    return {f.__name__: f for f in found}


#: Escapes as chat_format does, and counts the control strings around each turn.
_CHAT_SQL = r"""
with m as (select cast(conv_id as bigint) conv_id, cast(turn as bigint) turn, coalesce(role, '') as "role", coalesce(text, '') as "text" from conversations
           union all select -7, t, case t when 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from generate_series(0, 1) g(t)),
     e as (select *, replace(replace("text", '\', '\b'), '<', '\l') body, replace(replace("role", '\', '\b'), '<', '\l') head from m)
select conv_id, count(*) n_turns, sha256(string_agg("role" || chr(10) || "text" || chr(10), '' order by turn nulls first, "role", body)) turns_sha256,
       cast(sum(case when "role" = 'assistant' then length("text") else 0 end) as bigint) loss_chars,
       sha256(coalesce(string_agg(case when "role" = 'assistant' then "text" end, '' order by turn nulls first, "role", body), '')) loss_sha256,
       cast(sum(length(head) + length(body) + length('<|role|><|text|><|end|>')) as bigint) formatted_chars
from e group by conv_id"""


_NEGATIVES_SQL = """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end lab, list_transform(embedding, lambda x: floor(256 * cast(x as double))) v
           from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select a.vec_id anchor_id, a.lab alab, b.vec_id id, b.lab blab, cast(list_inner_product(a.v, b.v) as bigint) score from r a, r b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
     p as (select anchor_id, alab, id positive_id, score positive_score from s where alab = blab qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
     n as (select p.anchor_id, positive_id, positive_score, s.id negative_id, s.score negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) k
           from p join s on s.anchor_id = p.anchor_id and s.blab <> p.alab and 80 * positive_score <= 100 * s.score and s.score <= positive_score)
select anchor_id, positive_id, cast(k as int) as "rank", negative_id, positive_score, negative_score from n where k <= 5"""

_WARC_SQL = """
with p as (select page_id, coalesce(html, '') html, strlen(coalesce(html, '')) payload_bytes from pages),
     r as (select *, min(page_id) over (partition by html) first from p)
select page_id, cast(payload_bytes as bigint) payload_bytes, sha256(html) payload_digest,
       case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end record_type,
       case when payload_bytes >= 100 and page_id <> first then first end refers_to
from r"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": _CHAT_SQL, "op12_hard_negatives": _NEGATIVES_SQL, "op13_warc": _WARC_SQL}
