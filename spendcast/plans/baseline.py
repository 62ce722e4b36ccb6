"""Probability of passing the threshold, read off last month's spend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcast.functions.calendar import month_offset
from spendcast.functions.scoring import clip_probability
from spendcast.operators.labels import generate_labels
from spendcast.operators.snapshots import SNAPSHOT
from spendcast.schema import SPEND_THRESHOLD


def baseline_no_ml(transactions: DataFrame, month: str, threshold: float = SPEND_THRESHOLD) -> DataFrame:
    """``(customer_id, label, previous_total, probability)`` for each customer of the month's universe.

    Both months come from one aggregate, so a customer's two rows are already in one task.
    """
    previous = month_offset(month, 1)
    both = generate_labels(transactions, [previous, month], threshold)
    in_previous = F.col(SNAPSHOT) == previous
    paired = both.groupBy("customer_id").agg(
        F.coalesce(F.max(F.when(in_previous, F.col("total"))), F.lit(0.0)).alias("previous_total"),
        F.max(F.when(~in_previous, F.col("label"))).alias("label"),
    )
    probability = clip_probability(F.col("previous_total"), threshold)
    return paired.select("customer_id", "label", "previous_total", probability.alias("probability"))
