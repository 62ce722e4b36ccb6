from __future__ import annotations

import math
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendcast.functions.calendar import (
    derive_time_keys,
    filter_before_snapshot,
    filter_month,
    filter_through_month,
    month_offset,
    month_offset_column,
)
from spendcast.functions.scoring import binarize, clip_probability, exact_sum, null_for_nan, threshold_label
from spendcast.functions.stats import name_aggregates
from spendcast.operators.ordered import order_rows, running_sums
from spendcast.operators.running_totals import order_log, running_totals
from spendcast.schema import FEATURES, RUNNING_COLUMNS, STATISTICS


def test_feature_names():
    assert len(RUNNING_COLUMNS) == 21
    assert len(FEATURES) == len(set(FEATURES)) == 174


@pytest.mark.parametrize("month, n, expected", [("2011-12", 1, "2011-11"), ("2011-01", 1, "2010-12"), ("2011-12", 12, "2010-12"), ("2011-12", -1, "2012-01")])
def test_month_offset(spark, month, n, expected):
    assert month_offset(month, n) == expected
    row = spark.range(1).select(month_offset_column(F.lit(month), n).alias("m")).first()
    assert row.m == expected


def test_time_keys_are_padded_strings(spark):
    df = spark.createDataFrame([("2011-03-04 05:06:07",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("order_date"))
    row = derive_time_keys(df).first()
    assert (row.order_date_year_month, row.order_date_year, row.order_date_hour) == ("2011-03", "2011", "05")


def test_month_filters_are_half_open(purchases):
    assert filter_month(purchases, "2011-11").count() == 5
    assert filter_before_snapshot(purchases, "2011-11").count() == 4
    assert filter_through_month(purchases, "2011-11").count() == 9


def test_month_filter_reaches_the_scan(ordered):
    plan = filter_month(ordered, "1996-02")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(order_date" in pushed and "LessThan(order_date" in pushed


def test_column_rules(spark):
    df = spark.createDataFrame([(300.0,), (300.01,), (-5.0,), (900.0,), (150.0,), (math.nan,)], "x double")
    rows = df.select(
        threshold_label(F.col("x")).alias("label"),
        clip_probability(F.col("x")).alias("p"),
        binarize(clip_probability(F.col("x"))).alias("b"),
        null_for_nan(F.col("x")).alias("v"),
    ).collect()
    assert [r.label for r in rows[:5]] == [0, 1, 0, 1, 0]
    assert [r.p for r in rows[:5]] == [1.0, 1.0, 0.0, 1.0, 0.5]
    assert [r.b for r in rows[:5]] == [1, 1, 0, 1, 0]
    assert rows[5].v is None


@pytest.mark.parametrize("chunks", [1, 7, 40])
def test_sums_are_exact(spark, chunks):
    """Small decimals are not rounded away, and large totals keep their last digits, in sums and running totals alike."""
    cases = {1: [0.00165] * 10, 2: [1e12] + [0.0001] * 9, 3: [1e15, -0.5, 1e15], 4: [-0.1, -0.2, 0.3], 5: [123456.789012] * 3}
    rows = [(k, i, x) for k, xs in cases.items() for i, x in enumerate(xs)]
    log = spark.createDataFrame(rows, "customer_id long, order_id long, total double").selectExpr(
        "*", "total AS quantity", "total AS price", "order_id AS product_id", "'x' AS country", "timestamp_ntz'2011-01-01' AS order_date"
    )
    totals = running_totals(order_log(log, chunks), ["customer_id"]).groupBy("customer_id")
    last = {r.customer_id: r.t for r in totals.agg(F.max_by("cumsum_total_by_cust_id", "order_id").alias("t")).collect()}
    sums = {r.customer_id: r.s for r in log.groupBy("customer_id").agg(exact_sum("total").alias("s")).collect()}
    exact = {k: float(sum(Decimal(repr(x)) for x in xs)) for k, xs in cases.items()}
    assert last == exact and sums == exact


def test_order_is_total(spark):
    """Rows that differ in price alone get the same totals whatever their order of arrival."""
    rows = [(1, 1, 1.0, float(p)) for p in (1, 2, 3)]
    seen = set()
    for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0)):
        log = spark.createDataFrame([rows[i] for i in order], "customer_id long, order_id long, total double, price double")
        log = log.selectExpr("*", "total AS quantity", "1L AS product_id", "'x' AS country", "timestamp_ntz'2011-01-01' AS order_date")
        totals = running_totals(order_log(log, 2), ["customer_id"])
        seen.add(tuple(sorted((r.price, r.cumsum_price_by_cust_id) for r in totals.collect())))
    assert seen == {((1.0, 1.0), (2.0, 3.0), (3.0, 6.0))}


def test_a_task_holds_one_chunk(spark):
    log = spark.range(4000).selectExpr("id AS k", "1L AS x")
    summed = running_sums(order_rows(log, ["k"], 40), {"k": {"s": "x"}})
    placed = summed.select("chunk", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(placed) == len({r.task for r in placed}) == 40


def test_statistics_match_a_data_frame_group_by(spark):
    groups = {1: [5.0], 2: [1.0, 4.0], 3: [1.0, 2.0, 9.0], 4: [7.0] * 3, 5: [1.0, 2.0, 4.0, 9.0], 6: [None], 7: [3.0, None, 8.0]}
    rows = [(k, v) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k int, x double")
    ours = df.groupBy("k").agg(*name_aggregates(["x"], STATISTICS)).orderBy("k").toPandas().set_index("k")
    theirs = pd.DataFrame(rows, columns=["k", "x"]).astype({"x": float}).groupby("k")["x"].agg(list(STATISTICS))
    for s in STATISTICS:
        pd.testing.assert_series_equal(
            ours[f"x__{s}"].astype(float), theirs[s].astype(float), check_names=False, check_index_type=False
        )


def test_separator(spark):
    df = spark.range(3).selectExpr("id as k", "id as x").groupBy("k").agg(*name_aggregates(["x"], ["max"], "-"))
    assert df.columns == ["k", "x-max"]
