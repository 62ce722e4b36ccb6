"""Monthly spend labels per customer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcast.functions.calendar import filter_month, filter_through_month, moment, month_offset
from spendcast.functions.scoring import FROM_PARTS_SQL, REST_SQL, WHOLE_SQL, exact_sum, fill_missing_zero, threshold_label
from spendcast.operators.snapshots import SNAPSHOT
from spendcast.schema import SPEND_THRESHOLD

UNIVERSES = ("through", "before")


def customer_universe(transactions: DataFrame, month: str) -> DataFrame:
    """Every customer seen through the month, those first seen in it included."""
    return filter_through_month(transactions, month).select("customer_id").distinct()


def monthly_customer_total(transactions: DataFrame) -> DataFrame:
    """Spend per customer and month; rows without a customer belong to no group."""
    return (
        transactions.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id", F.date_format("order_date", "yyyy-MM").alias(SNAPSHOT))
        .agg(exact_sum("total").alias("total"))
    )


def label_universe_join(universe: DataFrame, totals: DataFrame, month: str) -> DataFrame:
    """Universe customers with their total of the month, NULL when they bought nothing."""
    return universe.withColumn(SNAPSHOT, F.lit(month)).join(totals, ["customer_id", SNAPSHOT], "left")


def label_by_join(transactions: DataFrame, month: str, threshold: float = SPEND_THRESHOLD) -> DataFrame:
    """The label table as universe, month totals and a left join. :func:`generate_labels` needs one pass."""
    joined = label_universe_join(
        customer_universe(transactions, month), monthly_customer_total(filter_month(transactions, month)), month
    )
    total = fill_missing_zero(F.col("total"))
    return joined.select("customer_id", SNAPSHOT, total.alias("total"), threshold_label(total, threshold).alias("label"))


def _month_totals(df: DataFrame, months: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """Per month the sums of whole parts and rests, and the totals made of them."""
    sums, totals = [], []
    for i, month in enumerate(months):
        inside = (F.col("order_date") >= moment(df, month)) & (F.col("order_date") < moment(df, month_offset(month, -1)))
        # a row without a customer is in the universe but in no group of totals
        counted = inside & F.col("customer_id").isNotNull()
        for part, sql in (("whole", WHOLE_SQL), ("rest", REST_SQL)):
            sums.append(F.sum(F.when(counted, F.expr(sql.format(c="total")))).alias(f"{part}_{i}"))
        totals.append(fill_missing_zero(F.expr(FROM_PARTS_SQL.format(w=f"whole_{i}", r=f"rest_{i}"))).alias(f"total_{i}"))
    return sums, totals


def generate_labels(
    transactions: DataFrame,
    months: Sequence[str],
    threshold: float = SPEND_THRESHOLD,
    universe: str = "through",
) -> DataFrame:
    """``(customer_id, year_month, total, label)`` for each month, from one aggregate over the log.

    ``universe='before'`` keeps only customers seen before the month. The default also keeps those first
    seen in it, who are there because they bought, which leaks the label.
    """
    if universe not in UNIVERSES:
        raise ValueError(f"universe must be one of {UNIVERSES}")
    log = filter_through_month(transactions, max(months))
    sums, totals = _month_totals(log, months)
    per_customer = (
        log.groupBy("customer_id")
        .agg(F.min("order_date").alias("first_seen"), *sums)
        .select("customer_id", "first_seen", *totals)
    )
    limit = {"through": -1, "before": 0}[universe]
    per_month = F.array(
        *[
            F.struct(
                F.lit(m).alias(SNAPSHOT),
                F.col(f"total_{i}").alias("total"),
                (F.col("first_seen") < moment(log, month_offset(m, limit))).alias("known"),
            )
            for i, m in enumerate(months)
        ]
    )
    return (
        per_customer.select("customer_id", F.inline(per_month))
        .where("known")
        .select("customer_id", SNAPSHOT, "total", threshold_label(F.col("total"), threshold).alias("label"))
    )


def generate_label(
    transactions: DataFrame, month: str, threshold: float = SPEND_THRESHOLD, universe: str = "through"
) -> DataFrame:
    return generate_labels(transactions, [month], threshold, universe)


def label_sorted(labels: DataFrame) -> DataFrame:
    """For display only; every later step joins by key."""
    return labels.orderBy(F.asc_nulls_last("customer_id"))
