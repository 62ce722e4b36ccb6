"""Joins between labels, features and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcast.operators.snapshots import SNAPSHOT

KEY_COLUMNS = ("customer_id", SNAPSHOT, "label")


def train_matrix_join(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Every label row, with NULL features where the customer has no history before the month.

    Features become doubles: a count that is missing may be filled with a median between two counts.
    """
    return labels.join(_doubles(features), ["customer_id", SNAPSHOT], "left")


def _doubles(features: DataFrame) -> DataFrame:
    counts = [f.name for f in features.schema if isinstance(f.dataType, T.LongType) and f.name != "customer_id"]
    return features.withColumns({c: F.col(c).cast("double") for c in counts})


def test_matrix_join(labels: DataFrame, features: DataFrame) -> DataFrame:
    """The same for one snapshot, whose features carry no month."""
    return labels.join(_doubles(features.drop(SNAPSHOT)), ["customer_id"], "left")


def rename_previous_total(labels: DataFrame) -> DataFrame:
    return labels.withColumnRenamed("total", "previous_total")


def previous_month_join(labels: DataFrame, previous: DataFrame) -> DataFrame:
    """Labels of a month with each customer's total of the month before."""
    totals = rename_previous_total(previous).select("customer_id", "previous_total")
    return labels.join(totals, ["customer_id"], "left")


def select_features(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c not in KEY_COLUMNS]


def attach_predictions(template: DataFrame, predictions: DataFrame, fill: float | None = None) -> DataFrame:
    """Fill a submission by customer, not by row position; other columns of the template stay.

    A customer without a prediction gets ``fill``, or NULL where none is given.
    """
    scores = predictions.select("customer_id", "probability")
    joined = template.drop("probability").join(scores, ["customer_id"], "left")
    return joined if fill is None else joined.fillna({"probability": fill})


def union_vocabulary(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    return train.select(column).unionByName(test.select(column)).where(F.col(column).isNotNull()).distinct()
