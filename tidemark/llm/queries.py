"""The corpus queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, conversations, decontaminate, filter_audit, quality, repeats, sharding, simhash, token_counts, topk, toxicity, url_filter, warc
from tidemark.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_two_pass_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op2(table(spark, sf_dir, "documents"))


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op3(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op4(table(spark, sf_dir, "documents"))


def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op6(table(spark, sf_dir, "embeddings"))


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op8(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op9(table(spark, sf_dir, "documents"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op10(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.op11(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.op12(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_two_pass_sharding, op3_warc_bundles, op4_bpe, op5_latent_decontamination, op6_exact_top_k, op7_compression_quality, op8_url_filter, op9_token_counts, op10_simhash_near_dedup,
        op11_substring_dedup, op12_conversation_repair, op13_filter_audit,
    )
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op3_warc_bundles": warc.ORACLE_SQL, "op6_exact_top_k": topk.ORACLE_SQL, "op8_url_filter": url_filter.ORACLE_SQL, "op11_substring_dedup": repeats.ORACLE_SQL, "op12_conversation_repair": conversations.ORACLE_SQL, "op13_filter_audit": filter_audit.ORACLE_SQL,
}
