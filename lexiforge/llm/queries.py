"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import chat_format, decontaminate, divergence, language, lexical, line_dedup, minhash, mixing, oracles, quality, sharding, substring_dedup, suffix_dedup, warc
from lexiforge.llm.common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_strings(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))


def op4_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.conversations_as_rows(_table(spark, sf_dir, "conversations"))
    return chat_format.format_preferences(chat_format.neighbours_as_pairs(rows))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The shares of the tokens of wanted domains that op6 mixes to.
WEIGHTS = {"high": 0.7, "low": 0.3}


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.document_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), WEIGHTS)
    return rates.drop("row_key").withColumn("kept", F.col("copies") > 0)


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
r AS (SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest, CASE WHEN strlen(payload) >= 100 AND page_id > first THEN first END AS refers_to FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_round_trip, op2_suffix_array_dedup, op3_substring_dedup, op4_chat_preferences, op5_line_dedup, op6_soft_mixing, op7_shard, op8_minhash_near_dedup, op9_benchmark_decontamination, op10_quality_rules, op11_source_divergence, op12_lexical_search, op13_language_id)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_round_trip": OP1,
        "op3_substring_dedup": oracles.SUBSTRINGS,
        "op4_chat_preferences": chat_format.ORACLE,
        "op5_line_dedup": line_dedup.ORACLE,
        "op8_minhash_near_dedup": oracles.NEAR_DUPLICATES,
        "op9_benchmark_decontamination": decontaminate.ORACLE,
        "op10_quality_rules": oracles.QUALITY,
        "op11_source_divergence": divergence.ORACLE,
        "op12_lexical_search": lexical.ORACLE,
    }
