"""Parameter profiles of the three back-ends, and what they mean for Spark's boosted trees."""

from __future__ import annotations

import math
from collections.abc import Mapping

from spendcast.schema import SEED

# Default and tuned parameters of each profile.
PROFILES: dict[str, dict[str, dict[str, float]]] = {
    "lgbm": {
        "default": {
            "feature_fraction": 0.8,
            "bagging_fraction": 0.8,
            "bagging_freq": 1,
            "n_estimators": 10000,
            "early_stopping_rounds": 100,
        },
        "tuned": {
            "num_leaves": 51,
            "max_bin": 217,
            "min_data_in_leaf": 25,
            "feature_fraction": 0.6305316867933471,
            "bagging_fraction": 0.2813784915565985,
            "bagging_freq": 4,
            "n_estimators": 10000,
            "early_stopping_rounds": 159,
            "lambda_l1": 5.7868521928893335,
            "lambda_l2": 1.3182546836846302e-07,
        },
    },
    "xgb": {
        "default": {
            "learning_rate": 0.1,
            "max_depth": 6,
            "colsample_bytree": 0.8,
            "subsample": 0.8,
            "n_estimators": 10000,
            "early_stopping_rounds": 100,
        },
        "tuned": {
            "learning_rate": 0.025936970485555613,
            "max_depth": 3,
            "colsample_bytree": 0.1590915485786206,
            "subsample": 0.14915913020164723,
            "n_estimators": 10000,
            "early_stopping_rounds": 100,
        },
    },
    "cat": {
        "default": {
            "n_estimators": 10000,
            "learning_rate": 0.07,
            "metric_period": 100,
            "od_wait": 100,
            "depth": 6,
            "rsm": 0.8,
        },
        "tuned": {
            "n_estimators": 10000,
            "learning_rate": 0.009264948818291454,
            "metric_period": 39,
            "od_wait": 128,
            "depth": 5,
            "rsm": 0.6398179008529061,
        },
    },
}

# How each profile measures importance; "used" counts splits and leaves out a feature
# that any fold did not use.
IMPORTANCE = {"lgbm": "split", "xgb": "used", "cat": "gain"}

# Number of search trials per profile, and (distribution, low, high) of each parameter.
TRIALS = {"lgbm": 20, "xgb": 5, "cat": 15}
SEARCH_SPACE: dict[str, dict[str, tuple[str, float, float]]] = {
    "lgbm": {
        "num_leaves": ("int", 2, 256),
        "max_bin": ("int", 128, 256),
        "min_data_in_leaf": ("int", 10, 40),
        "feature_fraction": ("uniform", 0.2, 1.0),
        "bagging_fraction": ("uniform", 0.2, 1.0),
        "bagging_freq": ("int", 1, 7),
        "early_stopping_rounds": ("int", 10, 500),
        "lambda_l1": ("log", 1e-8, 10.0),
        "lambda_l2": ("log", 1e-8, 10.0),
    },
    "xgb": {
        "learning_rate": ("log", 1e-3, 0.1),
        "max_depth": ("int", 2, 20),
        "colsample_bytree": ("log", 0.1, 1.0),
        "subsample": ("log", 0.1, 1.0),
    },
    "cat": {
        "learning_rate": ("log", 1e-3, 0.1),
        "metric_period": ("int", 10, 50),
        "od_wait": ("int", 10, 200),
        "depth": ("int", 2, 8),
        "rsm": ("uniform", 0.2, 1.0),
    },
}

# Parameters without a counterpart in Spark's boosted trees.
UNSUPPORTED = ("bagging_freq", "lambda_l1", "lambda_l2", "metric_period")

# Spark grows trees level by level and refuses more than 30 levels; so does this.
DEEPEST = 30


def patience_of(params: Mapping[str, float]) -> int | None:
    rounds = params.get("early_stopping_rounds", params.get("od_wait"))
    return None if rounds is None else int(rounds)


def gbt_params(
    params: Mapping[str, float], max_rounds: int | None = None, seed: int = SEED, strict: bool = False
) -> dict[str, object]:
    """Keyword arguments of ``GBTClassifier``. ``strict`` refuses what Spark cannot honour.

    Rounds are the profile's own unless ``max_rounds`` sets a lower limit; with patience, most of them are never fitted.
    """
    refused = sorted(set(params) & set(UNSUPPORTED))
    if strict and refused:
        raise ValueError(f"no counterpart in Spark: {', '.join(refused)}")
    rounds = [int(n) for n in (params.get("n_estimators"), max_rounds) if n is not None]
    spark: dict[str, object] = {"seed": seed} | ({"maxIter": min(rounds)} if rounds else {})
    for name, value in params.items():
        if name == "learning_rate":
            spark["stepSize"] = float(value)
        elif name in ("max_depth", "depth"):
            if int(value) > DEEPEST:
                raise ValueError(f"Spark grows at most {DEEPEST} levels, {name} asks for {int(value)}")
            spark["maxDepth"] = int(value)
        elif name == "num_leaves":
            spark["maxDepth"] = max(1, math.ceil(math.log2(value)))
        elif name in ("feature_fraction", "colsample_bytree", "rsm"):
            spark["featureSubsetStrategy"] = f"{float(value):.6f}"
        elif name in ("bagging_fraction", "subsample"):
            spark["subsamplingRate"] = float(value)
        elif name == "max_bin":
            spark["maxBins"] = int(value)
        elif name == "min_data_in_leaf":
            spark["minInstancesPerNode"] = int(value)
    return spark
