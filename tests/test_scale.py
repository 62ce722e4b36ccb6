"""Steps that must grow no faster than their input: what a plan moves between tasks, and that rows stay the same."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import queries as checks
from spendcast.functions.scoring import FROM_PARTS_SQL, FROM_UNITS_SQL, REST_SQL
from spendcast.operators import features
from spendcast.operators.ordered import order_rows
from spendcast.operators.running_totals import order_log, running_totals
from spendcast.schema import TRANSACTION_SCHEMA

MONTHS = ["2001-01", "2001-02", "2001-03", "2001-04"]


def log_of(spark, n=400, customers=7, products=9):
    draw = random.Random(5)
    rows = []
    for i in range(n):
        day = dt.datetime(2000, 12, 1) + dt.timedelta(days=draw.randrange(130))
        customer = None if i % 29 == 0 else 1 if i % 2 else draw.randrange(customers)
        product = None if i % 31 == 0 else draw.randrange(products)
        country = None if i % 17 == 0 else draw.choice("abc")
        rows.append((i // 3, product, customer, country, day, float(draw.randrange(9)), 1.5, None if i % 23 == 0 else i * 0.25))
    return rows, spark.createDataFrame(rows, TRANSACTION_SCHEMA)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_modes_repeat_no_value_per_snapshot(spark, monkeypatch, block):
    """The same with customers that are cut into parts. No value of a customer is repeated for the snapshots."""
    monkeypatch.setattr(features, "ROWS_PER_BLOCK", block)
    rows, log = log_of(spark)
    modes = features.snapshot_modes(log, MONTHS, ["product_id", "country"])
    plan = plan_of(modes)
    expected = {}
    for month in MONTHS:
        for customer in {r[2] for r in rows} - {None}:
            before = [r for r in rows if r[2] == customer and f"{r[4]:%Y-%m}" < month]
            best = [Counter(r[c] for r in before if r[c] is not None) for c in (1, 3)]
            if any(best):
                expected[customer, month] = tuple(min(b, key=lambda v: (-b[v], v)) if b else None for b in best)
    assert {(r.customer_id, r.year_month): (r.product_id__mode, r.country__mode) for r in modes.collect()} == expected
    exploded = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(exploded) == 1 and "product_id#" not in exploded[0].split("explode")[0]
    # counting and comparing values needs no shuffle after the one by customer: it, and one row per customer and interval
    assert plan.count("Exchange hashpartitioning") == 2


def test_statistics_meet_by_customer_before_they_are_taken(spark, monkeypatch):
    _, log = log_of(spark)
    monkeypatch.setattr(checks, "tx", lambda s, d: log)
    for query in (checks.snapshot_range_join_query, checks.statistic("skew")):
        plan = plan_of(query(spark, ""))
        # rows meet below the partial states, and below the rows that are repeated per snapshot
        assert "REBALANCE_PARTITIONS_BY_COL" in plan[max(plan.find("partial_"), plan.find("Generate explode")) :]


def test_stages_are_summed_once_per_customer(spark, monkeypatch, tmp_path):
    """Sums of all stages are sixty sums over a customer's months, and not a search of all months for each stage."""
    day = dt.datetime(2001, 7, 9)
    rows = [(1, 1, 1, "a", day, 1.0, 1.0, 1.0), (2, 1, 1, "a", dt.datetime(2001, 5, 3), 1.0, 1.0, 1.0), (3, 1, 2, "a", dt.datetime(1990, 1, 1), 1.0, 1.0, 1.0)]
    monkeypatch.setattr(checks, "tx", lambda s, d: s.createDataFrame(rows, TRANSACTION_SCHEMA))
    staged = checks.staged_predictions(spark, str(tmp_path))
    assert "lambdafunction" not in plan_of(staged)
    found = {r.fold: r._margins for r in staged.collect()}
    assert found[1] == [1.0, 1.0] + [2.0] * (checks.STAGES - 2)
    assert found[2] == [0.0] * checks.STAGES


def test_large_sums_are_the_nearest_double_without_decimals(spark):
    """Sums around every limit, ties between two doubles, and both signs."""
    draw = random.Random(3)
    units = [s * (draw.randrange(10**k) + d) for k in range(1, 19) for s in (1, -1) for d in (0, 5_000_000)]
    units += [s * ((2**29 + 2**k) * 10**7 + 10**7 // 2**j) for k in (3, 20, 29) for j in range(8) for s in (1, -1)] + [9 * 10**15, 2**63 - 1]
    rows = [(u, u // 10**7 + d, u % 10**7 - d * 10**7) for u in units for d in (0, -3, 10**9)]
    df = spark.createDataFrame(rows, "u long, w long, r long")
    got = df.select("u", F.expr(FROM_UNITS_SQL.format(u="u")).alias("a"), F.expr(FROM_PARTS_SQL.format(w="w", r="r")).alias("b")).collect()
    assert all(x.a == x.b == x.u / 10**7 for x in got)
    assert "decimal" not in FROM_UNITS_SQL.lower()


def test_rests_are_rounded_half_up(spark):
    amounts = [0.1, 2.5, -1.25, 0.00000005, 0.00000015, 3.99999995, 1.99999999999, -7.123456789, 0.49999999999999994 / 1e7, 5.0]
    got = spark.createDataFrame([(x,) for x in amounts], "x double").select(F.expr(REST_SQL.format(c="x"))).collect()
    parts = [(x - np.floor(x)) * 1e7 for x in amounts]
    assert [r[0] for r in got] == [int(Decimal(repr(float(p))).quantize(0, ROUND_HALF_UP)) for p in parts]


def test_seven_totals_sort_a_chunk_once(spark):
    """Before, each key had a sort and a window of its own over all rows, and rows were sorted again for their statistics."""
    _, log = log_of(spark)
    plan = plan_of(running_totals(order_log(log.withColumn("line_no", F.lit(1)).withColumn("supplier_id", F.lit(1))), number_customers=True))
    # the windows that are left carry sums from chunk to chunk
    assert plan.count("windowspecdefinition(chunk") == 0 and " MapInArrow" in plan
    assert [line for line in plan.splitlines() if "Sort [" in line and "seq#" in line and "Range" not in line].__len__() == 1


@pytest.mark.parametrize("block, batch", [(1_000_000, 10_000), (3, 4)])
def test_statistics_of_customers_that_are_cut(spark, monkeypatch, block, batch):
    """The same from whole customers as from customers cut by blocks and by batches; no row is repeated for a snapshot."""
    monkeypatch.setattr(features, "ROWS_PER_BLOCK", block)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows, log = log_of(spark)
        ordered = order_rows(log.withColumn("customer_row", F.lit(1).cast("long")), ["order_id"], 3)
        numbered = ordered.withColumn("customer_row", F.col("order_id") + 1)
        statistics = features.statistics_by_rows(numbered, MONTHS, ["total", "quantity"])
        assert "explode" not in plan_of(statistics)
        got = {(r.customer_id, r.year_month): r for r in statistics.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for month in MONTHS:
        for customer in {r[2] for r in rows} - {None}:
            own = [r for r in rows if r[2] == customer and f"{r[4]:%Y-%m}" < month]
            assert ((customer, month) in got) == bool(own)
            for c, at in (("total", 7), ("quantity", 5)):
                x = np.array([r[at] for r in own if r[at] is not None])
                r = got[customer, month] if own else None
                if len(x):
                    assert (r[f"{c}__count"], r[f"{c}__sum"], r[f"{c}__min"], r[f"{c}__max"]) == (len(x), x.sum(), x.min(), x.max())
                    assert r[f"{c}__mean"] == x.sum() / len(x)
                if len(x) > 2:
                    assert r[f"{c}__std"] == pytest.approx(x.std(ddof=1), abs=1e-9)
                    m2, m3 = ((x - x.mean()) ** 2).mean(), ((x - x.mean()) ** 3).mean()
                    skew = m3 / m2**1.5 * np.sqrt(len(x) * (len(x) - 1)) / (len(x) - 2) if m2 > 1e-12 else 0.0
                    assert r[f"{c}__skew"] == pytest.approx(skew, abs=1e-9)
