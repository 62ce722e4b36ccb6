"""Seeded random search over a profile's parameter space."""

from __future__ import annotations

import math
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from spendcast.operators.metrics import roc_auc
from spendcast.plans.boosting import blended_test, fit_folds, prepare_folds
from spendcast.plans.feature_matrix import Matrices
from spendcast.plans.profiles import PROFILES, SEARCH_SPACE, TRIALS, gbt_params, patience_of
from spendcast.schema import SEED


def _draw(name: str, distribution: str, low: float, high: float, seed: int) -> Column:
    """A value that depends on the trial, the parameter and the seed only, by a digest that any engine can repeat."""
    digest = F.md5(F.concat(F.lit(f"{seed}/{name}/"), F.col("trial").cast("string")))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(16.0**13)
    if distribution == "log":
        return F.exp(F.lit(math.log(low)) + u * F.lit(math.log(high) - math.log(low)))
    if distribution == "int":
        return F.floor(F.lit(low) + u * F.lit(high - low + 1)).cast("double")
    return F.lit(low) + u * F.lit(high - low)


def search_space(spark: SparkSession, profile: str, n_trials: int | None = None, seed: int = SEED) -> DataFrame:
    """``(trial, params)`` with one drawn parameter map per trial."""
    pairs = []
    for name, (distribution, low, high) in SEARCH_SPACE[profile].items():
        pairs += [F.lit(name), _draw(name, distribution, float(low), float(high), seed)]
    trials = spark.range(n_trials or TRIALS[profile]).select(F.col("id").cast("int").alias("trial"))
    return trials.select("trial", F.create_map(*pairs).alias("params"))


def tune(
    matrices: Matrices,
    profile: str,
    n_trials: int | None = None,
    folds: int = 10,
    max_rounds: int | None = None,
    seed: int = SEED,
    overrides: Mapping[str, object] | None = None,
    at_once: int = 4,
    parallelism: int = 2,
) -> DataFrame:
    """``(trial, params, val_auc)``: the hold-out AUC of each trial's blended predictions.

    Features, folds and assembled rows are made once for all trials. ``at_once`` trials are fitted side by side, each with
    ``parallelism`` folds at a time and in a scheduler pool of its own, so that a long trial does not hold up the others
    where the session schedules fairly. The predictions of all trials are scored together, in one job.
    """
    spark = matrices.train.sparkSession
    trials = search_space(spark, profile, n_trials, seed)
    prepared = prepare_folds(matrices.train, matrices.test, matrices.features, folds, seed, matrices.categories)

    def predictions(row: Row) -> DataFrame:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{row.trial}")
        # what the search leaves open keeps its default, early stopping among it
        params = PROFILES[profile]["default"] | dict(row.params)
        settings = gbt_params(params, max_rounds, seed) | dict(overrides or {})
        fitted = fit_folds(prepared, settings, patience_of(params), parallelism)
        return blended_test(prepared, fitted).withColumn("trial", F.lit(row.trial))

    rows = trials.collect()  # one row per trial
    with ThreadPoolExecutor(min(at_once, len(rows))) as pool:
        scored = list(pool.map(inheritable_thread_target(spark)(predictions), rows))
    areas = roc_auc(reduce(DataFrame.unionByName, scored), by="trial")
    return trials.join(areas, "trial").select("trial", "params", F.col("auc").alias("val_auc"))


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the highest hold-out AUC, the earliest on a tie."""
    return trials.orderBy(F.desc("val_auc"), "trial").limit(1)
