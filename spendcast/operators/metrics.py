"""Precision, recall, F1 and exact ROC-AUC as distributed aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcast.functions.scoring import binarize
from spendcast.operators.ordered import order_rows, running_sums


def _confusion(label: str, score: str, cut: float) -> dict[str, Column]:
    predicted, actual = binarize(F.col(score), cut) == 1, F.col(label) == 1
    return {
        "tp": F.count_if(predicted & actual),
        "fp": F.count_if(predicted & ~actual),
        "fn": F.count_if(~predicted & actual),
    }


def _rate(part: Column, whole: Column) -> Column:
    """0 when nothing is predicted, or nothing is there to be found."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def threshold_scores(predictions: DataFrame, label: str = "label", score: str = "probability", cut: float = 0.5) -> DataFrame:
    """One row of precision, recall and F1."""
    c = _confusion(label, score, cut)
    return predictions.agg(
        _rate(c["tp"], c["tp"] + c["fp"]).alias("precision"),
        _rate(c["tp"], c["tp"] + c["fn"]).alias("recall"),
        _rate(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]).alias("f1"),
    )


def roc_auc(
    predictions: DataFrame, label: str = "label", score: str = "probability", by: str | None = None
) -> DataFrame:
    """Exact area under the ROC curve, ties counting one half; NULL when only one class is present.

    Rows collapse to their distinct scores first, and the negatives below a score are a chunked running
    sum, so neither a popular score nor a single group ends up in one task. With ``by`` there is one area
    per value of that column.
    """
    group = by or "all"
    scored = predictions if by else predictions.withColumn(group, F.lit(0))
    points = scored.groupBy(group, score).agg(
        F.count_if(F.col(label) == 1).cast("double").alias("positives"),
        F.count_if(F.col(label) == 0).cast("double").alias("negatives"),
    )
    ordered = order_rows(points, [group, score])
    curve = running_sums(ordered, {group: {"negatives_through": "negatives"}})
    ranked = F.sum(F.col("positives") * (F.col("negatives_through") - F.col("negatives") / 2))
    area = F.try_divide(ranked, F.sum("positives") * F.sum("negatives"))
    return curve.groupBy(group).agg(area.alias("auc")).select(*([group] if by else []), "auc")


def classification_report(
    predictions: DataFrame, label: str = "label", score: str = "probability", cut: float = 0.5
) -> DataFrame:
    """``(metric, value)`` rows for precision, recall, F1 and ROC-AUC."""
    rates = threshold_scores(predictions, label, score, cut).unpivot(
        [], ["precision", "recall", "f1"], "metric", "value"
    )
    area = roc_auc(predictions, label, score).select(F.lit("roc_auc").alias("metric"), F.col("auc").alias("value"))
    return rates.unionByName(area)
