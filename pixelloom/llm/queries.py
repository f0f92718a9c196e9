"""The operators over their whole tables, with production parameters, and their
DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, line_dedup, mixing, near_dedup, packing, quality, sharding, token_counts, url_rules


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_read(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_read(spark, sf_dir, "conversations"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_pairs(_read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_matches(_read(spark, sf_dir, "documents")).drop("row")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.keep_good(_read(spark, sf_dir, "documents")).select("doc_id", "lang", "source")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_rules.mine(url_rules.label_pages(pages, _read(spark, sf_dir, "labels")))
    return url_rules.filter_urls(pages, rules.df)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a text share a shard."""
    return sharding.shard(_read(spark, sf_dir, "documents"), F.md5("text"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_winners(_read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.prefix_counts(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.mix_sql(),
        "op2_chat_format": chat.CHAT_SQL,
        "op4_line_dedup": line_dedup.lines_sql(),
        "op5_quality_rules": quality.quality_sql(kept="doc_id, lang, source"),
        "op8_exact_dedup": exact_dedup.EXACT_SQL,
    }
