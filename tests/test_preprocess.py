from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import spendcast.operators.preprocess as prep
from spendcast.operators.preprocess import detect_categoricals, label_codes, label_encode, median_fit, median_impute, preprocess


def median(values):
    values = sorted(v for v in values if v is not None)
    return (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2


def columns_of_all_shapes(n):
    rng = random.Random(3)
    return [
        (
            rng.gauss(0, 1e6),
            float(rng.randrange(3)),
            5.0,
            None if rng.random() < 0.7 else rng.random(),
            1.0 if i % 3 == 0 else rng.lognormvariate(0, 4),
            i,
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("n", [1, 2, 5, 8, 1001, 20_000])
def test_medians_are_exact(spark, n):
    rows = columns_of_all_shapes(max(n, 8))[:n] if n > 5 else [(1.0 * i, 2.0, 5.0, 0.5, -1.0 * i, i) for i in range(n)]
    names = ["gauss", "few", "constant", "sparse", "copies", "whole"]
    df = spark.createDataFrame(rows, "gauss double, few double, constant double, sparse double, copies double, whole long")
    df = df.withColumn("whole", F.col("whole").cast("double")).repartition(3)
    got = median_fit(df, names)
    for i, name in enumerate(names):
        assert got[name] == median([float(r[i]) if r[i] is not None else None for r in rows]), name


def test_a_bracket_that_misses_is_ranked_in_full(spark, monkeypatch):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"), (-F.col("id")).cast("double").alias("y"))
    monkeypatch.setattr(prep, "MARGIN", -0.3)  # low above high: no middle rank is inside
    assert median_fit(df, ["x", "y"]) == {"x": 500.0, "y": -500.0}


def test_a_column_without_values_is_named(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, gone double")
    with pytest.raises(ValueError, match="gone"):
        median_fit(df, ["x", "gone"])


def test_codes_are_ranks(spark):
    vocabulary = spark.createDataFrame([(c,) for c in "zebra apple mango Äpfel Zoo".split()], "v string")
    codes = {r.v: r.code for r in label_codes(vocabulary, "v").collect()}
    assert codes == {v: i for i, v in enumerate(sorted(codes))}


def test_encoding_is_fitted_on_both_sides(spark):
    train = spark.createDataFrame([("b", 1), (None, 2), ("d", 3)], "c string, i int")
    test = spark.createDataFrame([("a", 1), ("c", 2)], "c string, i int")
    coded = label_encode(train, test, "c")
    assert {r.i: r.c for r in coded[0].collect()} == {1: 1, 2: None, 3: 3}
    assert {r.i: r.c for r in coded[1].collect()} == {1: 0, 2: 2}


def test_preprocess(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", None), ("b", 4.0)], "c string, x double")
    test = spark.createDataFrame([("c", None)], "c string, x double")
    assert detect_categoricals(train, ["c", "x"]) == ["c"]
    x_tr, x_te = preprocess(train, test, ["c", "x"])
    assert sorted(map(tuple, x_tr.collect())) == [(0, 2.5), (1, 1.0), (1, 4.0)]
    assert [tuple(r) for r in x_te.collect()] == [(2, 2.5)]
    assert preprocess(train, test, ["x"], impute=False)[1].first().x is None
    assert median_impute(test, {"x": 9.0}).first().x == 9.0
