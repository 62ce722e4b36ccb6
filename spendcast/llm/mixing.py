"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / size of the source`` copies. The expectations are summed up along
the source, one offset is added, and a document is taken once for each whole number that its part of the sum
crosses. The documents lie in order of size, so each stretch of like sizes gives its share and the words taken
stay within about one document of the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendcast.llm.text import ROW_TAG, n_words, steadily_tagged, tagged, without
from spendcast.operators.ordered import CHUNK, SEQ, order_rows, running_sums
from spendcast.session import materialize

# Expected copies are whole numbers of 2^-28: their sums are exact, whatever the chunks.
BITS = 28
WEIGHTS = (3, 1, 2)


def targets(
    sizes: DataFrame,
    source: str = "source",
    size: str = "size",
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    limit: float = 2.0,
) -> DataFrame:
    """One row per source: ``source``, ``source_size`` and ``target``.

    Sources in code point order, NULL last, weigh ``weights`` in turn and share ``share`` times all sizes. No target
    passes ``limit`` times the source's size; what is above goes to the others by weight. In the order of ``limit *
    size / weight``, the level (words for a weight of 1) after filling the sources before is highest just where
    filling ends, so that level is the maximum of all and nothing has to be repeated.
    """
    per_source = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = per_source.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(limit)))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col(source).asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select(source, "source_size", F.least("most", F.col("weight") * F.col("level")).alias("target"))
    )


def offset(source: Column, seed: int) -> Column:
    """The one random offset of a source, from 0 to below 2^28."""
    name = F.concat(F.lit(f"{seed}/"), F.coalesce(source.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long")


def expected_copies(documents: DataFrame, per_source: DataFrame, source: str = "source") -> DataFrame:
    """Add ``source_size``, ``target`` and ``expected`` copies in units of 2^-28, the same for all documents of a source."""
    named = per_source.withColumnRenamed(source, "source_of_target")
    units = F.round(F.col("target") / F.col("source_size") * F.lit(2.0**BITS)).cast("long")
    return (
        documents.join(named, F.col(source).eqNullSafe(F.col("source_of_target")))
        .drop("source_of_target")
        .withColumn("expected", F.when(F.col("source_size") > 0, units).otherwise(F.lit(0).cast("long")))
    )


def systematic_copies(ordered: DataFrame, source: str = "source", seed: int = 42) -> DataFrame:
    """Add ``copies`` to documents in order (``order_rows``) that carry ``expected``: the whole numbers each crosses."""
    # a NULL source has running sums as well
    keyed = ordered.withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))
    summed = running_sums(keyed, {"source_key": {"up_to": "expected"}})
    start = offset(F.col(source), seed)
    upper = F.shiftright(F.col("up_to") + start, BITS)
    lower = F.shiftright(F.col("up_to") - F.col("expected") + start, BITS)
    return summed.withColumn("copies", (upper - lower).cast("long")).drop("source_key", "up_to", "expected", CHUNK, SEQ)


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 42,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: ``key``, ``source``, ``size`` in words, ``source_size``, ``target``, ``copies``, ``taken``.

    A NULL or empty text has size 0 and gives no words, whatever its copies. A NULL source is a source. Rows that
    repeat are drawn each by itself. No document is taken more than ``limit`` times, rounded up. ``keep`` names more
    columns to carry along. An empty table gives an empty one.
    """
    sized = docs.select(key, source, n_words(text).alias("size"), *keep)
    tag = [] if ROW_TAG in keep else [ROW_TAG]
    ordered = order_rows(tagged(sized) if tag else sized, [source, "size", key, ROW_TAG])
    # written, so that its size is known: Spark then broadcasts it below its own threshold and shuffles it above
    per_source = materialize(targets(ordered, source, "size", weights, share, limit), "targets")
    drawn = systematic_copies(expected_copies(ordered, per_source, source), source, seed)
    return drawn.withColumn("taken", F.col("copies") * F.col("size")).drop(*tag)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: every row as often as it is taken, with its own columns."""
    numbered = steadily_tagged(without(docs, ROW_TAG))
    drawn = mix(numbered, keep=[ROW_TAG], **options).where("copies > 0")
    copies = drawn.select(ROW_TAG, F.sequence(F.lit(1).cast("long"), F.col("copies")).alias("_copies"))
    return (
        numbered.join(copies, ROW_TAG)
        .select(*[numbered[f"`{c}`"] for c in numbered.columns if c != ROW_TAG], F.explode("_copies").alias("_copy"))
        .drop("_copy")
    )
