"""Queries of the subpackage for the driver contract, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import bpe, chat, decontaminate, divergence, lines, media, packing, resample, simhash, sql, storage, substring, suffix, tokenbin, toxicity


def vocabulary(name: str) -> str:
    """Where the public vocabulary files live; callers may pass any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.bounded(storage.spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.fit_score(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(documents(spark, sf_dir))


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.page_media(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(documents(spark, sf_dir))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_records(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicate(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), benchmark(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_chat": op2_chat,
        "op3_media_columns": op3_media_columns,
        "media_pages": media_pages,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_decontaminate": op5_decontaminate,
        "op6_packing": op6_packing,
        "op7_token_binary": op7_token_binary,
        "op8_simhash": op8_simhash,
        "op9_line_dedup": op9_line_dedup,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_source_divergence": op11_source_divergence,
        "op12_bpe": op12_bpe,
        "op13_resample": op13_resample,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
