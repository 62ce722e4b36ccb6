from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spendcast.operators.folds import blend_folds, fold_split, importance_fold_join, mean_importance, stratified_folds
from spendcast.operators.labels import generate_label
from spendcast.operators.metrics import classification_report, roc_auc, threshold_scores
from tests.conftest import same_rows


def pairwise_auc(pairs):
    positive = [p for y, p in pairs if y == 1]
    negative = [p for y, p in pairs if y == 0]
    wins = sum((a > b) + (a == b) / 2 for a in positive for b in negative)
    return wins / (len(positive) * len(negative))


@pytest.fixture(scope="module")
def predictions(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, int(rng.random() < 0.3), 0.5 if i % 3 == 0 else round(rng.random(), 2)) for i in range(400)]
    return spark.createDataFrame(rows, "id int, fold int, label int, probability double").cache()


def test_auc_counts_pairs(predictions):
    rows = predictions.collect()
    assert roc_auc(predictions).first().auc == pytest.approx(pairwise_auc([(r.label, r.probability) for r in rows]), rel=1e-12)
    for r in roc_auc(predictions, by="fold").collect():
        expected = pairwise_auc([(x.label, x.probability) for x in rows if x.fold == r.fold])
        assert r.auc == pytest.approx(expected, rel=1e-12)


def test_auc_of_reversed_scores(predictions):
    reversed_scores = predictions.withColumn("probability", -F.col("probability"))
    assert roc_auc(reversed_scores).first().auc == pytest.approx(1 - roc_auc(predictions).first().auc, rel=1e-12)


def test_one_class_has_no_auc(predictions):
    assert roc_auc(predictions.where("label = 1")).first().auc is None


def test_rates(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.51), (0, 0.1)], "label int, probability double")
    assert tuple(threshold_scores(df).first()) == (0.5, 0.5, 0.5)
    assert tuple(threshold_scores(df, cut=0.95).first()) == (0.0, 0.0, 0.0)
    report = {r.metric: r.value for r in classification_report(df).collect()}
    assert report == {"precision": 0.5, "recall": 0.5, "f1": 0.5, "roc_auc": 0.5 + 0.25 - 0.0}


def test_fold_sizes_differ_by_one_at_most(spark, log):
    labels = generate_label(log, "1996-02")
    folded = stratified_folds(labels, 5)
    assert same_rows(labels, folded)
    for label in (0, 1):
        sizes = [r["count"] for r in folded.where(F.col("label") == label).groupBy("fold").count().collect()]
        assert max(sizes) - min(sizes) <= 1
    again = stratified_folds(labels.repartition(7), 5)
    assert same_rows(folded, again)
    other = stratified_folds(labels, 5, seed=1)
    assert not same_rows(folded, other)
    split = fold_split(folded, 2)
    assert split.where("is_val").count() == folded.where("fold = 2").count()


def test_fold_aggregates(spark):
    importances = spark.createDataFrame(
        [("a", 0, 2.0), ("a", 1, 4.0), ("b", 0, 6.0)], "feature string, fold int, importance double"
    )
    assert {r.feature: r.importance for r in mean_importance(importances).collect()} == {"a": 3.0, "b": 6.0}
    assert {r.feature: r.importance for r in importance_fold_join(importances, 2).collect()} == {"a": 3.0}
    blended = blend_folds(spark.createDataFrame([(1, 0.2), (1, 0.4), (2, 1.0)], "customer_id long, probability double"))
    assert {r.customer_id: round(r.probability, 9) for r in blended.collect()} == {1: 0.3, 2: 1.0}
