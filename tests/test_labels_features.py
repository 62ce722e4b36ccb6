from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendcast.operators.features import customer_snapshot_features, snapshot_distinct_counts, statistics_by_rows, statistics_by_states
from spendcast.operators.labels import customer_universe, generate_label, generate_labels, label_by_join, label_sorted
from spendcast.operators.matrix import attach_predictions, previous_month_join
from spendcast.operators.mode import feat_mode
from spendcast.operators.running_totals import running_totals_by_window
from spendcast.operators.snapshots import snapshot_range_join, union_snapshots
from spendcast.plans.baseline import baseline_no_ml
from spendcast.plans.feature_matrix import feature_engineering, snapshot_matrix
from spendcast.schema import DISTINCT_COLUMNS, FEATURES, MEASURES, STATISTICS
from tests.conftest import same_rows


def by_customer(df):
    return {r.customer_id: r for r in df.collect()}


def test_label_edges(purchases):
    got = by_customer(generate_label(purchases, "2011-11"))
    assert {c: (r.total, r.label) for c, r in got.items()} == {
        1: (300.0, 0),
        2: (300.01, 1),
        3: (-5.0, 0),
        4: (400.0, 1),
        6: (0.0, 0),
        None: (0.0, 0),
    }
    assert label_sorted(generate_label(purchases, "2011-11")).collect()[-1].customer_id is None


def test_universe_before_leaves_out_new_customers(purchases):
    assert set(by_customer(generate_label(purchases, "2011-11", universe="before"))) == {1, 2, 3, 6}
    with pytest.raises(ValueError):
        generate_label(purchases, "2011-11", universe="after")


@pytest.mark.parametrize("month", ["2011-10", "2011-11", "2011-12"])
def test_one_pass_labels_equal_the_join(purchases, month):
    assert same_rows(generate_label(purchases, month), label_by_join(purchases, month))
    assert generate_label(purchases, month).count() == customer_universe(purchases, month).count()


def test_several_months_equal_one_by_one(log):
    months = ["1996-01", "1996-02", "2000-05"]
    single = [generate_label(log, m) for m in months]
    assert same_rows(generate_labels(log, months), single[0].unionByName(single[1]).unionByName(single[2]))


def test_baseline_clips_refunds_and_large_totals(purchases):
    got = by_customer(baseline_no_ml(purchases, "2011-11"))
    assert {c: r.probability for c, r in got.items()} == {1: 200 / 300, 2: 0.0, 3: 1.0, 4: 0.0, 6: 0.0, None: 0.0}
    joined = by_customer(previous_month_join(generate_label(purchases, "2011-11"), generate_label(purchases, "2011-10")))
    assert joined[4].previous_total is None and joined[3].previous_total == 900.0


def test_attach_is_by_key(spark):
    template = spark.createDataFrame([(2, 0.0), (1, 0.0), (9, 0.0)], "customer_id long, probability double")
    predictions = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "customer_id long, probability double")
    assert {r.customer_id: r.probability for r in attach_predictions(template, predictions).collect()} == {1: 0.1, 2: 0.2, 9: None}


def test_range_join_equals_union(log):
    months = ["1996-01", "1996-02", "1999-07"]
    assert same_rows(snapshot_range_join(log, months), union_snapshots(log, months))



def test_all_features_match_a_single_node_data_frame(log, ordered):
    months = ["1996-02", "2001-07"]
    ours = customer_snapshot_features(ordered, months).toPandas()
    rows = running_totals_by_window(log).toPandas()
    for month in months:
        history = rows[rows.order_date < pd.Timestamp(f"{month}-01")]
        groups = history.groupby("customer_id")
        expected = groups[list(MEASURES)].agg(list(STATISTICS))
        expected.columns = [f"{c}__{s}" for c, s in expected.columns]
        for c in DISTINCT_COLUMNS:
            expected[f"{c}__nunique"] = groups[c].nunique()
        got = ours[ours.year_month == month].set_index("customer_id").sort_index()
        assert set(FEATURES) == set(got.columns) - {"year_month"}
        assert list(got.index) == list(expected.index)
        for c in FEATURES:
            np.testing.assert_allclose(
                got[c].astype(float), expected[c].astype(float), rtol=1e-6, atol=1e-6, err_msg=f"{month} {c}"
            )


def test_states_of_intervals_merge_to_the_statistics_of_rows(spark):
    """Constant values far from zero, gaps between a customer's intervals, values missing in an interval, one row only."""
    rows = []
    for c in range(30):
        for i in range(c % 9 + 1):
            day = f"2011-{(c * 5 + i * i * 3) % 12 + 1:02d}-{i + 1:02d}"
            rows.append((c, day, 1e9 + 5.3, None if (c + i) % 4 == 0 else float((c * 7919 + i * 104729) % 1000) / 8, 1e6 + i % 2, 1))
    rows += [(None, "2011-01-01", 1.0, 2.0, 3.0, 1), (99, "2011-12-31", 1.0, None, 3.0, 1)]
    df = spark.createDataFrame(rows, "customer_id long, d string, constant double, gaps double, near double, customer_row long")
    df = df.withColumn("order_date", F.col("d").cast("timestamp_ntz")).repartition(3)
    months = ["2011-02", "2011-03", "2011-07", "2011-08", "2012-01"]
    names = ("constant", "gaps", "near")
    got = statistics_by_states(df, months, names).toPandas().set_index(["customer_id", "year_month"]).sort_index()
    expected = statistics_by_rows(df, months, names).toPandas().set_index(["customer_id", "year_month"]).sort_index()
    assert list(got.index) == list(expected.index)
    for c in expected.columns:
        np.testing.assert_allclose(got[c].astype(float), expected[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_distinct_counts_skip_null(spark):
    rows = [(1, 1, 7, "2011-01-01"), (1, 1, None, "2011-01-02"), (1, 2, 8, "2011-03-01"), (None, 3, 9, "2011-01-01")]
    df = spark.createDataFrame(rows, "customer_id long, order_id long, product_id long, d string")
    df = df.select("*", F.col("d").cast("timestamp_ntz").alias("order_date"), F.lit("UK").alias("country"))
    got = {r.year_month: r for r in snapshot_distinct_counts(df, ["2011-02", "2011-04"]).collect()}
    assert len(got) == 2
    assert (got["2011-02"].order_id__nunique, got["2011-02"].product_id__nunique) == (1, 1)
    assert (got["2011-04"].order_id__nunique, got["2011-04"].product_id__nunique) == (2, 2)
    assert (got["2011-02"].order_date_year_month__nunique, got["2011-04"].order_date_year_month__nunique) == (1, 2)


def test_mode_takes_the_lowest_on_a_tie(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (1, 3), (1, 5), (2, 9), (2, None)], "k int, x int")
    assert {r.k: r.x__mode for r in feat_mode(df, "k", "x").collect()} == {1: 3, 2: 9}


def test_late_joiners_get_the_train_median(log, ordered):
    m = feature_engineering(ordered, "1996-02")
    raw = snapshot_matrix(ordered, "1996-02").toPandas()
    train = raw[raw.year_month == "1996-01"]
    medians = train[m.features].astype(float).median()
    new = raw[(raw.year_month == "1996-02") & raw.total__count.isna()].customer_id
    filled = m.test.toPandas().set_index("customer_id")
    assert len(new) > 0
    for customer in new:
        np.testing.assert_allclose(filled.loc[customer, m.features].astype(float), medians, rtol=1e-12)
    assert m.train.count() == len(train)
    assert not filled[m.features].isna().any().any()
