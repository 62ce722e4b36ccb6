"""Modes, sketches, gaps, categories and observed counts: what the feature table and the models can be asked for."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spendcast.operators.features import customer_snapshot_features, snapshot_approx_distinct_counts, snapshot_distinct_counts, snapshot_modes
from spendcast.operators.mode import feat_mode
from spendcast.operators.preprocess import mark_gaps, nominal_codes
from spendcast.operators.snapshots import tag_snapshot
from spendcast.plans.boosting import MOST_CATEGORIES, VECTOR, assemble, enough_bins, fit, gbt_fit_predict, gbt_oof, score
from spendcast.plans.feature_matrix import feature_engineering
from spendcast.session import materialize
from spendcast.sources.sinks import log_metrics, materialize_with_profile, read_metrics
from tests.conftest import same_rows

MONTHS = ["1996-01", "1999-07", "1997-03", "1996-02"]
DATED = "customer_id long, order_date string, product_id long, country string"
SMALL_FIT = {"maxIter": 3, "maxDepth": 3, "seed": 1}


def dated(spark, rows):
    return spark.createDataFrame(rows, DATED).withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))


def test_modes_equal_one_snapshot_at_a_time(log):
    got = snapshot_modes(log, MONTHS, ["product_id", "country"])
    for month in MONTHS:
        before = tag_snapshot(log, month)
        alone = feat_mode(before, "customer_id", "product_id").join(feat_mode(before, "customer_id", "country"), "customer_id")
        assert same_rows(got.where(F.col("year_month") == month).drop("year_month"), alone)


def test_modes_of_ties_and_gaps(spark):
    rows = [
        (1, "2020-01-05", 7, "b"),
        (1, "2020-01-06", 3, None),
        (1, "2020-02-07", 7, "a"),
        (2, "2020-01-01", None, None),
        (None, "2020-01-01", 1, "a"),
    ]
    got = snapshot_modes(dated(spark, rows), ["2020-02", "2020-03"], ["product_id", "country"])
    assert {(r.customer_id, r.year_month): (r.product_id__mode, r.country__mode) for r in got.collect()} == {
        (1, "2020-02"): (3, "b"),
        (1, "2020-03"): (7, "a"),
    }
    assert snapshot_modes(dated(spark, []), ["2020-02"], ["product_id"]).count() == 0


def test_sketches_are_exact_for_few_values_and_near_for_many(spark, log):
    assert same_rows(snapshot_approx_distinct_counts(log, MONTHS), snapshot_distinct_counts(log, MONTHS))
    many = spark.range(200_000).select(
        F.lit(1).cast("long").alias("customer_id"),
        F.when(F.col("id") % 2 == 0, F.lit("2020-01-01")).otherwise(F.lit("2020-02-01")).cast("timestamp_ntz").alias("order_date"),
        (F.col("id") % 100_000).alias("product_id"),
    )
    for error in (0.01, 0.05):
        counts = snapshot_approx_distinct_counts(many, ["2020-02", "2020-03"], ["product_id"], error)
        seen = {r.year_month: r.product_id__nunique for r in counts.collect()}
        assert seen["2020-02"] == pytest.approx(50_000, rel=4 * error)
        assert seen["2020-03"] == pytest.approx(100_000, rel=4 * error)
    with pytest.raises(ValueError):
        snapshot_approx_distinct_counts(log, MONTHS, error=0)
    assert snapshot_approx_distinct_counts(log.limit(0), MONTHS).count() == 0


def test_feature_table_with_modes_and_sketches(ordered):
    plain = customer_snapshot_features(ordered, ["1996-02"])
    more = customer_snapshot_features(ordered, ["1996-02"], modes=["country"], distinct_error=0.02)
    assert more.columns == [*plain.columns, "country__mode"]
    assert more.where("country__mode IS NULL").isEmpty()
    counts = [c for c in plain.columns if c.endswith("__nunique")]
    assert same_rows(more.select("customer_id", *counts), plain.select("customer_id", *counts))


def gappy(spark):
    kind = "customer_id long, year_month string, label int, a double, b double, c double, d double"
    train = [(i, "t", i % 2, None if i < 3 else float(i), None if i < 3 else -2.0, None if i == 5 else 0.5, None) for i in range(8)]
    test = [(9, "u", 0, None, 1.0, None, 4.0)]
    return spark.createDataFrame(train, kind), spark.createDataFrame(test, kind)


def test_gaps_get_a_value_below_all_and_one_mark_for_the_same_rows(spark):
    train, test, features = mark_gaps(*gappy(spark), ["a", "b", "c", "d"])
    assert features == ["a", "b", "c", "d", "a__missing", "c__missing", "d__missing"]
    rows = {r.customer_id: r for r in train.unionByName(test).collect()}
    assert [rows[0][f] for f in features] == [0.0, -4.0, 0.5, 0.0, 1.0, 0.0, 1.0]
    assert [rows[5][f] for f in features] == [5.0, -2.0, -0.5, 0.0, 0.0, 1.0, 1.0]
    assert [rows[9][f] for f in features] == [0.0, 1.0, -0.5, 4.0, 1.0, 1.0, 0.0]
    whole = train.select("customer_id", "year_month", "label", "a", "a__missing")
    with pytest.raises(ValueError, match="a__missing"):
        mark_gaps(gappy(spark)[0].withColumn("a__missing", F.lit(0)), gappy(spark)[1], ["a"])
    assert mark_gaps(whole, whole, ["a"])[2] == ["a"]


def test_a_model_splits_on_gaps(spark):
    train = spark.range(400).select(
        F.col("id").alias("customer_id"),
        F.lit("t").alias("year_month"),
        (F.col("id") % 4 == 0).cast("int").alias("label"),
        F.when(F.col("id") % 4 != 0, F.col("id") * 0.5).alias("a"),
    )
    with pytest.raises(Exception):
        gbt_fit_predict(train, train, ["a"], SMALL_FIT)
    filled, _, features = mark_gaps(train, train, ["a"])
    scored = gbt_fit_predict(filled, filled, features, SMALL_FIT).predictions
    assert scored.where("(probability > 0.5) <> (label = 1)").isEmpty()


def test_categories_need_no_order(spark):
    """Labels follow the parity of a code, which one split by order cannot tell and one split by category can."""
    codes = spark.range(800).select(
        F.col("id").alias("customer_id"),
        F.lit("t").alias("year_month"),
        (F.col("id") % 40 % 2).cast("int").alias("label"),
        F.when(F.col("id") % 40 < 39, F.concat(F.lit("k"), F.lpad((F.col("id") % 40).cast("string"), 2, "0"))).alias("kind"),
    )
    train, test, sizes = nominal_codes(codes, codes, ["kind"])
    assert sizes == {"kind": 40}
    assert {r.kind for r in train.where("customer_id % 40 = 39").select("kind").distinct().collect()} == {39.0}
    stump = {"maxIter": 1, "maxDepth": 1, "seed": 1}
    by_order = score(fit(assemble(train, ["kind"]), stump), assemble(test, ["kind"]))
    assert not by_order.where("(probability > 0.5) <> (label = 1)").isEmpty()
    by_category = gbt_fit_predict(train, test, ["kind"], stump, categories=sizes).predictions
    assert by_category.where("(probability > 0.5) <> (label = 1)").isEmpty()
    # the kind of a feature outlasts the written folds
    folded = gbt_oof(train, test, ["kind"], stump, folds=2, categories=sizes)
    assert folded.oof.where("(probability > 0.5) <> (label = 1)").isEmpty()


def test_bins_follow_the_largest_vocabulary(spark):
    row = spark.createDataFrame([(1, "t", 0, 1.0, 2.0)], "customer_id long, year_month string, label int, a double, b double")

    def bins(size, **params):
        stored = materialize(assemble(row, ["a", "b"], categories={"b": size}), "bins")
        assert stored.schema[VECTOR].metadata["ml_attr"]["attrs"]["nominal"][0]["num_vals"] == size
        return enough_bins(stored, params).get("maxBins")

    assert bins(40) == 40 and bins(20) is None and bins(40, maxBins=64) == 64
    with pytest.raises(ValueError, match="categories"):
        bins(MOST_CATEGORIES + 1)
    assert enough_bins(assemble(row, ["a", "b"]), {"maxDepth": 2}) == {"maxDepth": 2}


def test_matrices_with_categories_and_gaps(ordered):
    m = feature_engineering(ordered, "1996-02", impute=False, nominal=True, modes=["country"])
    assert m.categories["country__mode"] > 2 and "quantity__mean__missing" in m.features
    assert all(m.train.where(F.col(f).isNull()).isEmpty() for f in ("country__mode", "total__std", "quantity__mean"))
    scored = gbt_fit_predict(m.train, m.test, m.features, SMALL_FIT, categories=m.categories).predictions
    assert scored.count() == m.test.count() and scored.where("probability NOT BETWEEN 0 AND 1").isEmpty()


def test_counts_come_with_the_write(spark, log, tmp_path):
    odd = spark.createDataFrame([(1, None), (None, "x"), (3, None)], "n long, `a.b` string").repartition(3)
    stored, profile = materialize_with_profile(odd, "odd")
    row = profile.first()
    assert (row.n_rows, row.n_columns, row.categorical_columns, row.n_missing) == (3, 2, "a.b", {"n": 1, "a.b": 2})
    assert stored.count() == 3
    empty = materialize_with_profile(odd.limit(0), "empty")[1].first()
    assert empty.n_rows == 0 and empty.n_missing == {"n": 0, "a.b": 0}
    metrics = spark.createDataFrame([("auc", 0.5), ("f1", 0.1)], "metric string, value double")
    assert log_metrics(metrics, str(tmp_path / "m"), "run") == 2 == read_metrics(spark, str(tmp_path / "m")).count()
