"""From raw documents to packed training sequences, in stages that are written and read again.

Every stage takes the documents that the stage before left and returns documents with the same columns, but for the
last, which returns pieces with their places in sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcast.llm import mixing, near_dedup, packing, passages, quality
from spendcast.llm.text import ROW_TAG, steadily_tagged
from spendcast.session import freed, materialize

TOKENIZER = "byte_bpe_50k.json"
# Near-duplicate stages on word shingles: five words, similarity 0.8 or more.
SHINGLE, PERCENT = 5, 80

# No SQL can state the stages that tokenize, or cut passages found by hashing; their operators are tested one by one.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor a proven cutoff rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # columns by place, so that none has the name of a measure; they pass by the rules, so no text is moved
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()])
    key, text, lang = (own[c] for c in ("doc_id", "text", "lang"))
    rest = [o for o in own.values() if o not in (key, lang)]
    judged = quality.judge(named, labels.withColumnRenamed("doc_id", key), key, text, lang, keep=rest)
    return judged.where("kept").select(*[F.col(o).alias(c) for c, o in own.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest number, and of its repeated rows the first."""
    numbered = steadily_tagged(docs)
    with freed(spark) as scratch:
        found = near_dedup.near_duplicates(numbered.select(ROW_TAG, "text"), ROW_TAG, "text", PERCENT, SHINGLE)
        keys = numbered.select(F.col(ROW_TAG).alias("row"), "doc_id")
        named = found.select(F.col(ROW_TAG).alias("row"), "component_id").join(keys, "row")
        first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"))
        kept = scratch.keep(materialize(first.select(F.col("least.row").alias(ROW_TAG)), "kept-rows"))
    return numbered.join(kept, ROW_TAG, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; repeated passages are cut out of all but the one with the smallest doc_id that holds them."""
    return recounted(passages.without_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences. Rows taken twice have places of their own."""
    return packing.packed_documents(docs, public_tokenizers.path(TOKENIZER))


def recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a text that was cut."""
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        # what a stage wrote on its way is removed once its result is written
        with freed(spark) as scratch:
            docs = scratch.keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
    return docs
