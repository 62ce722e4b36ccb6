"""Most frequent value per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feat_mode(df: DataFrame, key: str, column: str, separator: str = "__") -> DataFrame:
    """The most frequent value of each key, the lowest on a tie.

    Values are counted per key first, so no task holds all values of a group.
    """
    counts = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).groupBy(key, column).count()
    best = F.min(F.struct((-F.col("count")).alias("fewer"), F.col(column).alias("value")))
    return counts.groupBy(key).agg(best["value"].alias(f"{column}{separator}mode"))
