"""The registered queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, editcount, langid, packing, quality, simhash, spm, tokenbin, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op1(_table(spark, sf_dir, "pages"))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op2(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op3(_table(spark, sf_dir, "documents"))


def op4_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op4(_table(spark, sf_dir, "conversations"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op5(_table(spark, sf_dir, "documents"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language operator on pages, which have markup and addresses."""
    return langid.pages_language(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.op7(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op8(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editcount.count_with_edits(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.op10(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = (
    op1_warc_normaliser,
    op2_simhash_components,
    op3_quality_rules,
    op4_chat_round_trip,
    op5_language_id,
    pages_language_id,
    op6_exact_top_k,
    op7_token_planes,
    op8_best_fit_packing,
    op9_token_counts,
    op10_sentencepiece,
    pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_normaliser": warc.ORACLE_SQL, "op3_quality_rules": quality.ORACLE_SQL, "op4_chat_round_trip": chat.ORACLE_SQL, "op6_exact_top_k": topk.ORACLE_SQL}
