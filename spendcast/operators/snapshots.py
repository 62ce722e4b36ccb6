"""Snapshot months: for each month, the rows strictly before it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcast.functions.calendar import filter_before_snapshot, moment

SNAPSHOT = "year_month"


def snapshot_months(labels: DataFrame) -> DataFrame:
    return labels.select(SNAPSHOT).distinct()


def snapshot_range_join(df: DataFrame, months: Sequence[str], date: str = "order_date") -> DataFrame:
    """Each row once per snapshot month it precedes.

    The months are a short list known to the driver, so this is a projection of each row and not a join:
    no second side, no nested loop, and nothing moves between tasks.
    """
    cutoffs = F.array(
        *[F.struct(F.lit(m).alias("month"), moment(df, m, date).alias("cutoff")) for m in months]
    )
    later = F.filter(cutoffs, lambda s: s["cutoff"] > F.col(date))
    return (
        filter_before_snapshot(df, max(months), date)
        .withColumn("_snapshot", F.explode(later))
        .withColumn(SNAPSHOT, F.col("_snapshot.month"))
        .drop("_snapshot")
    )


def tag_snapshot(df: DataFrame, month: str, date: str = "order_date") -> DataFrame:
    return filter_before_snapshot(df, month, date).withColumn(SNAPSHOT, F.lit(month))


def union_snapshots(df: DataFrame, months: Sequence[str], date: str = "order_date") -> DataFrame:
    """The same rows as :func:`snapshot_range_join`, one scan per month."""
    return reduce(lambda a, b: a.unionByName(b), [tag_snapshot(df, m, date) for m in months])
