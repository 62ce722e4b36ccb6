"""One query for each operator, over its whole table, and SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcast.llm import (
    decontaminate,
    lexical,
    mixing,
    near_dedup,
    packing,
    passages,
    phrases,
    quality,
    scoring,
    sharding,
    token_files,
    vectors,
    warc,
)
from spendcast.llm.sql import DECONTAMINATION, LEXICAL, MIXING, PHRASES, QUALITY, SHARDING
from spendcast.session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    read = token_files.read_token_files(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    built = warc.derivatives(warc.responses(table(spark, folder, "pages")))
    return built.withColumn("record_crc32", F.crc32("record")).drop("record")


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score(table(spark, folder, "documents"))


def op9_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top; it belongs to this package

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_near_dedup": op2_near_dedup,
        "op3_mixing": op3_mixing,
        "op4_packing": op4_packing,
        "op5_token_files": op5_token_files,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_warc": op7_warc,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_near_vectors": op9_near_vectors,
        "op10_sharding": op10_sharding,
        "op11_lexical_search": op11_lexical_search,
        "op12_collocations": op12_collocations,
        "op13_decontamination": op13_decontamination,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality": QUALITY,
        "op3_mixing": MIXING,
        "op10_sharding": SHARDING,
        "op11_lexical_search": LEXICAL,
        "op12_collocations": PHRASES,
        "op13_decontamination": DECONTAMINATION,
    }
