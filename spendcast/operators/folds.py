"""Stratified folds and the aggregates over folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcast.operators.ordered import CHUNK, SEQ, order_rows, running_sums
from spendcast.schema import SEED


def shuffle_key(seed: int, key: str = "customer_id") -> Column:
    """A fixed pseudo-random order: it depends on the row's key and the seed, not on partitions."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))


def stratified_folds(df: DataFrame, k: int = 10, seed: int = SEED, label: str = "label") -> DataFrame:
    """Add ``fold`` in 0…k-1 so that fold sizes within a label differ by at most one."""
    shuffled = df.withColumns({"_shuffle": shuffle_key(seed), "_one": F.lit(1).cast("bigint")})
    ordered = order_rows(shuffled, [label, "_shuffle", "customer_id"])
    ranked = running_sums(ordered, {label: {"_rank": "_one"}})
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop(
        "_shuffle", "_one", "_rank", SEQ, CHUNK
    )


def fold_split(df: DataFrame, fold: int) -> DataFrame:
    """Mark the validation rows of a fold; the rest is its training set."""
    return df.withColumn("is_val", F.col("fold") == fold)


def ordered_mean(column: str) -> Column:
    """Mean of one value per fold, added from the smallest up, so that it is the same in any order of arrival.

    A group has as many values as there are folds, so it is a short list.
    """
    values = F.array_sort(F.collect_list(column))
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda total, x: total + x), F.size(values).cast("double"))


def blend_folds(predictions: DataFrame, keys: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Mean over folds of each customer's predictions."""
    return predictions.groupBy(*keys).agg(ordered_mean("probability").alias("probability"))


def mean_fold_auc(fold_scores: DataFrame) -> DataFrame:
    return fold_scores.agg(ordered_mean("auc").alias("auc"))


def mean_importance(importances: DataFrame) -> DataFrame:
    """Mean importance of each feature over the folds it appears in."""
    return importances.groupBy("feature").agg(ordered_mean("importance").alias("importance"))


def importance_fold_join(importances: DataFrame, k: int) -> DataFrame:
    """The same, keeping only features every fold used."""
    means = importances.groupBy("feature").agg(ordered_mean("importance").alias("importance"), F.count("fold").alias("folds"))
    return means.where(F.col("folds") == k).select("feature", "importance")
