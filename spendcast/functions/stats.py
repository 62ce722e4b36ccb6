"""Per-group statistics with the missing-value rules of a data-frame group-by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendcast.functions.scoring import FROM_PARTS_SQL, REST_SQL, WHOLE_SQL, exact_sum_sql
from spendcast.schema import feature_column

# As SQL text, because the feature table takes 168 of them and one parsed expression is one call to the JVM.
#
# sum:  0 for a group without values; exact, so free of the noise of adding doubles.
# std:  the sample deviation, missing for one value.
# skew: Spark's skewness is that of a population. Corrected for bias it is missing below three values; a
#       constant group has none, and counts as 0.
STATISTIC_SQL = {
    "mean": "try_divide({sum}, count({c}))",
    "max": "max({c})",
    "min": "min({c})",
    "sum": "coalesce({sum}, 0D)",
    "count": "count({c})",
    "std": "stddev_samp({c})",
    "skew": (
        "CASE WHEN count({c}) >= 3 THEN "
        "coalesce(skewness({c}) * sqrt(count({c}) * (count({c}) - 1)) / (count({c}) - 2), 0D) END"
    ),
}


def statistic(column: str, name: str) -> Column:
    return F.expr(STATISTIC_SQL[name].format(c=f"`{column}`", sum=exact_sum_sql(f"`{column}`")))


def name_aggregates(columns: Sequence[str], statistics: Sequence[str], separator: str = "__") -> list[Column]:
    """One aliased aggregate per column and statistic, as ``<column>__<statistic>``."""
    return [statistic(c, s).alias(feature_column(c, s, separator)) for c in columns for s in statistics]


# A state that can be merged with that of other rows: count, exact sum in two parts, extremes, central moments.
STATE_SQL = {
    "_n": "count({c})",
    "_whole": f"sum({WHOLE_SQL})",
    "_rest": f"sum({REST_SQL})",
    "_min": "min({c})",
    "_max": "max({c})",
    "_m2": "var_pop({c}) * count({c})",
    "_m3": "coalesce(skewness({c}), 0D) * count({c}) * pow(var_pop({c}), 1.5D)",
}


def merged_mean_sql(column: str) -> str:
    """The mean of all rows so far, from their running count and sum."""
    return f"try_divide({FROM_PARTS_SQL.format(w=f'`{column}_whole_to`', r=f'`{column}_rest_to`')}, `{column}_n_to`)"


def merged_moment_sql(column: str, order: int) -> str:
    """The second or third central moment of all rows so far, about their mean, from the list ``past`` of states."""
    n, m2, m3, mean = (f"p.`{column}_{x}`" for x in ("n", "m2", "m3", "mean"))
    away = f"({mean} - `{column}_mean_to`)"
    term = f"{m2} + {n} * {away} * {away}" if order == 2 else f"{m3} + {away} * (3 * {m2} + {n} * {away} * {away})"
    return f"aggregate(past, 0D, (s, p) -> s + coalesce({term}, 0D))"


def merged_statistic_sql(column: str, name: str) -> str:
    """One statistic of all rows so far, from their running counts, sums, extremes and moments."""
    n, low, high, m2, m3 = (f"`{column}_{x}_to`" for x in ("n", "min", "max", "m2", "m3"))
    if name in ("min", "max", "count", "mean"):
        return {"min": low, "max": high, "count": n, "mean": f"`{column}_mean_to`"}[name]
    if name == "sum":
        return f"coalesce({FROM_PARTS_SQL.format(w=f'`{column}_whole_to`', r=f'`{column}_rest_to`')}, 0D)"
    if name == "std":
        return f"CASE WHEN {n} > 1 THEN CASE WHEN {low} = {high} THEN 0D ELSE sqrt({m2} / ({n} - 1)) END END"
    skew = f"sqrt({n} * ({n} - 1)) / ({n} - 2) * sqrt({n}) * {m3} / pow({m2}, 1.5D)"
    return f"CASE WHEN {n} >= 3 THEN CASE WHEN {low} = {high} THEN 0D ELSE coalesce({skew}, 0D) END END"
