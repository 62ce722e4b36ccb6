"""Small column rules: labels, fills, clips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendcast.schema import PLACES, SPEND_THRESHOLD


def threshold_label(total: Column, threshold: float = SPEND_THRESHOLD) -> Column:
    """1 only when spend is strictly above the threshold."""
    return (total > F.lit(threshold)).cast("int")


def fill_missing_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def clip_probability(total: Column, threshold: float = SPEND_THRESHOLD) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / F.lit(float(threshold))))


def binarize(probability: Column, cut: float = 0.5) -> Column:
    return (probability > F.lit(cut)).cast("int")


def null_for_nan(c: Column) -> Column:
    """Missing is NULL everywhere; NaN would sort and add up as a value."""
    return F.when(~F.isnan(c), c)


# As SQL text, because many of them make up one aggregate: an amount's whole part, and its rest in units, halves up.
WHOLE_SQL = "floor({c})"
_UNIT = f"1{'0' * PLACES}"
_REST = f"(({{c}} - floor({{c}})) * {_UNIT}D)"
REST_SQL = f"(CAST({_REST} AS BIGINT) + CASE WHEN {_REST} - CAST({_REST} AS BIGINT) >= 0.5D THEN 1L ELSE 0L END)"
# A whole number from 2^29 up to 2^52, as a double, plus a part of one in units is the double nearest to both: the part's
# own rounding, of 2^-54, is less than the distance of any such sum to the middle of two doubles, unless it lies in it.
_WHOLES = "BETWEEN 536870912L AND 4503599627370496L"
# The double nearest to a sum of both: one division while it is exact, such a sum, or through a decimal.
FROM_PARTS_SQL = (
    f"CASE WHEN abs({{w}}) < 4 * 1{'0' * (15 - PLACES)} AND abs({{r}}) < 4 * 1{'0' * 15} "
    f"THEN ({{w}} * {_UNIT} + {{r}}) / {_UNIT}D "
    f"WHEN abs({{w}} + {{r}} div {_UNIT}L) {_WHOLES} THEN CAST({{w}} + {{r}} div {_UNIT}L AS DOUBLE) + ({{r}} % {_UNIT}L) / {_UNIT}D "
    f"ELSE CAST(CAST({{w}} AS DECIMAL(19,0)) + CAST({{r}} AS DECIMAL(19,0)) * 0.{'0' * (PLACES - 1)}1BD AS DOUBLE) END"
)


# The same amount as one number of units, and the double nearest to a sum of units.
UNITS_SQL = f"({WHOLE_SQL} * {_UNIT}L + {REST_SQL})"
FROM_UNITS_SQL = (
    f"CASE WHEN abs({{u}}) < 9 * 1{'0' * 15}L THEN {{u}} / {_UNIT}D "
    f"ELSE CAST({{u}} div {_UNIT}L AS DOUBLE) + ({{u}} % {_UNIT}L) / {_UNIT}D END"
)
# Sums of amounts stay below 2^63 units where all amounts together stay below this.
MOST_IN_UNITS = 4.0 * 10 ** (18 - PLACES)


def exact_sum_sql(c: str) -> str:
    """The sum of a double column, NULL for no values."""
    return FROM_PARTS_SQL.format(w=f"sum({WHOLE_SQL.format(c=c)})", r=f"sum({REST_SQL.format(c=c)})")


def exact_sum(column: str) -> Column:
    return F.expr(exact_sum_sql(f"`{column}`"))
