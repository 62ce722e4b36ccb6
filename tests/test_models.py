from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spendcast.plans.boosting import (
    _best_round,
    assemble,
    feature_importance,
    fit,
    fit_folds,
    gbt_fit_predict,
    gbt_oof,
    patience_stop,
    prepare_folds,
    score,
    tree_margins,
    trees_between,
)
from spendcast.plans.feature_matrix import Matrices
from spendcast.plans.jobs import predict, validate
from spendcast.plans.profiles import PROFILES, SEARCH_SPACE, TRIALS, gbt_params, patience_of
from spendcast.plans.tuning import best_trial, search_space, tune
from spendcast.sources.sinks import read_metrics, read_submission_template
from tests.conftest import same_rows

FEATURES = ["signal", "noise", "idle"]
QUICK = {"maxIter": 4, "maxDepth": 2, "seed": 42, "stepSize": 0.3}


@pytest.fixture(scope="module")
def planted(spark):
    """A label that depends on one feature; one row has no customer."""
    df = spark.range(400).select(
        F.when(F.col("id") > 0, F.col("id")).alias("customer_id"),
        F.lit("2011-11").alias("year_month"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("signal"),
        (F.pmod(F.xxhash64(F.col("id") + 7), F.lit(1000)) / 1000).alias("noise"),
        F.lit(0.0).alias("idle"),
    )
    df = df.withColumn("label", (F.col("signal") + 0.1 * F.col("noise") > 0.6).cast("int")).cache()
    test = df.withColumn("year_month", F.lit("2011-12"))
    return Matrices(df, test, FEATURES)


@pytest.fixture(scope="module")
def model(planted):
    return fit(assemble(planted.train, FEATURES), QUICK)


def test_out_of_fold(planted):
    result = gbt_oof(planted.train, planted.test, FEATURES, QUICK, folds=3)
    assert result.oof.count() == planted.train.count()
    assert result.oof.where("customer_id IS NULL").count() == 1
    assert result.oof.groupBy("customer_id").count().where("count > 1").isEmpty()
    assert result.oof.where("probability < 0 OR probability > 1 OR probability IS NULL").isEmpty()
    assert result.test.count() == planted.test.count()
    assert result.oof_auc.first().auc > 0.9 and result.mean_auc.first().auc > 0.9
    assert result.fold_auc.count() == 3
    importance = {r.feature: r.importance for r in result.importance.collect()}
    assert importance["signal"] > importance["noise"] and importance["idle"] == 0.0
    again = gbt_oof(planted.train, planted.test, FEATURES, QUICK, folds=3)
    assert same_rows(result.test, again.test)


def test_early_stopping_keeps_a_prefix(planted):
    result = gbt_oof(planted.train, planted.test, FEATURES, QUICK, folds=2, patience=1, importance="used")
    assert result.oof.count() == planted.train.count() and result.oof_auc.first().auc > 0.9
    assert "idle" not in {r.feature for r in result.importance.collect()}


def test_best_round_and_patience():
    assert _best_round({1: 0.5, 2: 0.6, 3: 0.55, 4: 0.7}, patience=2) == 4
    assert _best_round({1: 0.5, 2: 0.6, 3: 0.55, 4: 0.7}, patience=1) == 2
    assert _best_round({1: 0.5, 2: 0.5}, patience=5) == 1


def test_patience_in_a_table_equals_round_by_round(spark):
    curves = [{1: 0.5, 2: 0.6, 3: 0.55, 4: 0.7}, {1: 0.5, 2: 0.5, 3: 0.5, 4: 0.5, 5: 0.9}, {1: None, 2: 0.4, 3: 0.4}, {1: 0.3}]
    rows = [(f, r, a) for f, c in enumerate(curves) for r, a in c.items()]
    table = spark.createDataFrame(rows, "fold int, rounds int, auc double").repartition(3)
    for patience in (1, 2, 3, 10):
        got = {r.fold: (r.rounds, r.stopped) for r in patience_stop(table, patience).collect()}
        for f, c in enumerate(curves):
            known = {r: -1.0 if a is None else a for r, a in c.items()}
            best = _best_round(known, patience)
            assert got[f] == (best, max(known) - best >= patience)


def test_profile_rounds_are_stopped_by_patience(planted):
    """Thousands of rounds are allowed, and a fold ends where its own curve has gained nothing for long enough."""
    params = gbt_params(PROFILES["xgb"]["default"]) | {"maxDepth": 2, "stepSize": 0.5}
    assert params["maxIter"] == 10_000
    prepared = prepare_folds(planted.train, planted.test, FEATURES, 2)
    fitted = fit_folds(prepared, params, patience=6)
    for fold, (model, rounds) in enumerate(fitted):
        assert rounds + 6 <= model.getNumTrees <= 128
        # the fold's curve, scored from the start with all trees, has its best round there
        own = prepared.folded.where(F.col("fold") == fold)
        margins = tree_margins(model, own).select("label", F.posexplode("_margins").alias("at", "margin")).toPandas()
        area = {}
        for at, rows in margins.groupby("at"):
            pos, neg = rows[rows.label == 1].margin.to_numpy(), rows[rows.label == 0].margin.to_numpy()
            area[at + 1] = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
        assert _best_round(area, 6) == rounds


def test_a_shorter_fit_begins_a_longer_one(planted):
    rows = assemble(planted.train, FEATURES)
    params = QUICK | {"subsamplingRate": 0.7, "featureSubsetStrategy": "0.7"}
    short, long = fit(rows, params | {"maxIter": 3}), fit(rows, params | {"maxIter": 7})
    assert [t.toDebugString.split("\n", 1)[1] for t in short.trees] == [t.toDebugString.split("\n", 1)[1] for t in long.trees[:3]]
    kept = tree_margins(short, rows).withColumn("m", F.element_at("_margins", -1)).drop("_margins")
    later = tree_margins(trees_between(long, 3), kept.where("customer_id IS NOT NULL"), F.col("m"))
    whole = {r.customer_id: r._margins[3:] for r in tree_margins(long, rows).collect() if r.customer_id}
    assert all(r._margins == pytest.approx(whole[r.customer_id], abs=1e-12) for r in later.collect())


def test_models_do_not_depend_on_partitions(planted):
    params = QUICK | {"subsamplingRate": 0.6, "featureSubsetStrategy": "0.7"}
    few, many = (fit(assemble(planted.train.repartition(n), FEATURES), params) for n in (3, 11))
    assert [t.toDebugString.split("\n", 1)[1] for t in few.trees] == [t.toDebugString.split("\n", 1)[1] for t in many.trees]


def test_all_trees_give_the_models_own_probability(planted, model):
    rows = assemble(planted.test, FEATURES)
    own = score(model, rows).select("customer_id", F.col("probability").alias("own"))
    staged = score(model, rows, len(model.trees)).select("customer_id", F.col("probability").alias("staged"))
    worst = own.join(staged, "customer_id").agg(F.max(F.abs(F.col("own") - F.col("staged")))).first()[0]
    assert worst < 1e-12
    assert tree_margins(model, rows).select(F.size("_margins")).first()[0] == len(model.trees)


def test_importance_kinds(spark, model):
    kinds = {k: {r.feature: r.importance for r in feature_importance(spark, model, FEATURES, k).collect()} for k in ("gain", "split", "used")}
    assert sum(kinds["gain"].values()) == pytest.approx(1.0)
    assert set(kinds["gain"]) == set(kinds["split"]) == set(FEATURES)
    assert "idle" not in kinds["used"]
    assert all(kinds["split"][f] == n for f, n in kinds["used"].items())


def test_fit_predict(planted):
    result = gbt_fit_predict(planted.train, planted.test, FEATURES, QUICK)
    assert result.predictions.count() == planted.test.count()
    assert result.importance.count() == len(FEATURES)


def test_parameter_mapping():
    lgbm = gbt_params(PROFILES["lgbm"]["tuned"])
    assert lgbm["maxDepth"] == 6 and lgbm["maxBins"] == 217 and lgbm["minInstancesPerNode"] == 25
    assert gbt_params(PROFILES["xgb"]["default"], 10) == {
        "seed": 42,
        "maxIter": 10,
        "stepSize": 0.1,
        "maxDepth": 6,
        "featureSubsetStrategy": "0.800000",
        "subsamplingRate": 0.8,
    }
    assert [patience_of(PROFILES[p]["tuned"]) for p in ("lgbm", "xgb", "cat")] == [159, 100, 128]
    with pytest.raises(ValueError, match="31"):
        gbt_params({"max_depth": 31})
    with pytest.raises(ValueError, match="lambda_l1"):
        gbt_params(PROFILES["lgbm"]["tuned"], strict=True)


@pytest.mark.parametrize("profile", list(SEARCH_SPACE))
def test_draws_stay_in_bounds(spark, profile):
    trials = search_space(spark, profile, 200).collect()
    for name, (kind, low, high) in SEARCH_SPACE[profile].items():
        drawn = [t.params[name] for t in trials]
        assert low <= min(drawn) and max(drawn) <= high and len(set(drawn)) > 5
        if kind == "int":
            assert all(v == int(v) for v in drawn)
    assert search_space(spark, profile).count() == TRIALS[profile]
    assert search_space(spark, profile, 200).collect() == trials


def test_tuning(planted):
    trials = tune(planted, "cat", n_trials=2, folds=2, max_rounds=2, overrides={"maxDepth": 2}).cache()
    rows = trials.collect()
    assert len(rows) == 2 and all(0.0 <= r.val_auc <= 1.0 for r in rows)
    assert best_trial(trials).first().val_auc == max(r.val_auc for r in rows)


def test_jobs(spark, ordered, tmp_path):
    metrics = str(tmp_path / "metrics")
    options = {"folds": 2, "max_rounds": 2, "overrides": {"maxDepth": 2}}
    result = validate(ordered, "1996-02", "cat", metrics, **options)
    logged = {r.name: r.value for r in read_metrics(spark, metrics).collect()}
    scores = {"precision", "recall", "f1", "roc_auc", "mean_auc", "oof_auc"}
    used = ("maxDepth", "maxIter", "stepSize", "featureSubsetStrategy", "seed", "folds", "patience")
    assert set(logged) == scores | {"features", "fold_auc_0", "fold_auc_1"} | {f"param_{k}" for k in used}
    assert (logged["features"], logged["param_maxDepth"], logged["param_maxIter"]) == (174, 2, 2)
    template = result.predictions.select("customer_id", F.lit("kept").alias("note"))
    for profile, extra in (("xgb", options), ("baseline", {})):
        path = str(tmp_path / profile)
        predict(ordered, "1996-02", profile, template, path, **extra)
        written = read_submission_template(spark, path)
        assert written.columns == ["customer_id", "note", "probability"]
        assert written.count() == template.count()
        assert written.where("probability BETWEEN 0 AND 1").count() == template.count()
