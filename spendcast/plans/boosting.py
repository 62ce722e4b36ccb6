"""Boosted-tree scoring: one model, or a model per fold with blended test predictions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendcast.operators.folds import (
    blend_folds,
    fold_split,
    importance_fold_join,
    mean_fold_auc,
    mean_importance,
    stratified_folds,
)
from spendcast.operators.metrics import roc_auc
from spendcast.schema import SEED
from spendcast.session import materialize, scratch_path

VECTOR = "features"
KEYS = ("customer_id", "year_month", "label")
# Rows of a partition of training rows; rounds of the first fit where rounds are stopped by patience.
ROWS_PER_PARTITION, FIRST_ROUNDS = 250_000, 8
TREES_AT_ONCE = 32
# Spark keeps statistics per category, feature and node, and as many bins for every feature as the largest has categories.
MOST_CATEGORIES, DEFAULT_BINS = 1_000, 32


class Fitted(NamedTuple):
    predictions: DataFrame
    importance: DataFrame


class OutOfFold(NamedTuple):
    """``oof`` and ``test`` are keyed predictions, ``importance`` is per feature, ``fold_auc`` per fold, ``rounds`` the
    number of trees of each fold's predictions."""

    oof: DataFrame
    test: DataFrame
    importance: DataFrame
    fold_auc: DataFrame
    mean_auc: DataFrame
    oof_auc: DataFrame
    rounds: list[int]


def assemble(
    df: DataFrame, features: Sequence[str], *extra: str, categories: Mapping[str, int] | None = None
) -> DataFrame:
    """The model's edge: keys, a numeric label and one vector column.

    ``categories`` names features whose values 0 to n - 1 have no order, and their n; the vector's metadata carry it.
    """
    for name, size in (categories or {}).items():
        df = df.withMetadata(name, {"ml_attr": {"type": "nominal", "name": name, "num_vals": size}})
    assembler = VectorAssembler(inputCols=list(features), outputCol=VECTOR, handleInvalid="error")
    return assembler.transform(df).select(*KEYS, *extra, VECTOR).withColumn("label", F.col("label").cast("double"))


def pinned(rows: DataFrame) -> DataFrame:
    """The rows in partitions and an order that their keys and number decide, however they are stored.

    Trees draw their rows by partition and place, so this is what makes a seeded fit repeatable.
    """
    partitions = max(1, -(-rows.count() // ROWS_PER_PARTITION))
    return rows.repartition(partitions, *KEYS[:2]).sortWithinPartitions(*KEYS[:2])


def enough_bins(train: DataFrame, params: Mapping[str, object]) -> dict[str, object]:
    """``params`` with a bin for each category of the largest nominal feature, at most ``MOST_CATEGORIES``."""
    attributes = train.schema[VECTOR].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
    largest = max(attributes, key=lambda a: a.get("num_vals", 0), default={})
    needed = largest.get("num_vals", 0)
    if needed > MOST_CATEGORIES:
        raise ValueError(f"{largest.get('name')} has {needed} categories, more than {MOST_CATEGORIES}: use it as a number")
    return dict(params) | ({"maxBins": needed} if needed > int(params.get("maxBins", DEFAULT_BINS)) else {})


def fit(train: DataFrame, params: Mapping[str, object]) -> GBTClassificationModel:
    """A model that is the same for the same rows, seed and parameters."""
    model = GBTClassifier(labelCol="label", featuresCol=VECTOR, **enough_bins(train, params)).fit(pinned(train))
    # the shuffle that laid out the rows belongs to no query that ends: its files go with the driver's object
    train.sparkSession._jvm.System.gc()
    return model


def trees_between(model: GBTClassificationModel, first: int, last: int | None = None) -> GBTClassificationModel:
    """An ensemble of the trees from ``first`` up to ``last``, with their weights. Each tree only adds to those before it."""
    own, context = model._java_obj, SparkSession.active().sparkContext
    ml, new_array = context._jvm.org.apache.spark.ml, context._gateway.new_array
    places = range(first, model.getNumTrees if last is None else last)
    trees, weights = new_array(ml.regression.DecisionTreeRegressionModel, len(places)), new_array(context._jvm.double, len(places))
    all_trees, all_weights = own.trees(), own.treeWeights()
    for i, place in enumerate(places):
        trees[i], weights[i] = all_trees[place], all_weights[place]
    return GBTClassificationModel(ml.classification.GBTClassificationModel(own.uid(), trees, weights))


def score(model: GBTClassificationModel, df: DataFrame, rounds: int | None = None) -> DataFrame:
    """``df`` with ``probability``, from the first ``rounds`` trees where a number is given."""
    if rounds is not None:
        model = trees_between(model, 0, rounds)
    scored = model.transform(df).withColumn("probability", vector_to_array("probability")[1])
    return scored.drop(VECTOR, "rawPrediction", "prediction")


def saved_nodes(spark: SparkSession, model: GBTClassificationModel) -> DataFrame:
    """The nodes of all trees, ``treeID`` and ``nodeData``."""
    path = scratch_path(spark, "model")
    model.write().save(path)
    return spark.read.parquet(f"{path}/data")


def leaf_steps(model: GBTClassificationModel) -> list[list[float]]:
    """What each leaf of each tree adds to the margin, leaves from left to right."""
    leaves = saved_nodes(SparkSession.active(), model).where("nodeData.leftChild < 0")
    per_tree = leaves.groupBy("treeID").agg(F.array_sort(F.collect_list(F.struct("nodeData.id", "nodeData.prediction"))).alias("leaves"))
    found = {r["treeID"]: [x["prediction"] for x in r["leaves"]] for r in per_tree.collect()}  # one row per tree
    return [[value * weight for value in found[i]] for i, weight in enumerate(model.treeWeights)]


def tree_margins(model: GBTClassificationModel, df: DataFrame, start: Column | None = None) -> DataFrame:
    """``df`` with ``_margins``: what the ensemble says after one tree, after two, and so on, from ``start`` on.

    Each tree says which leaf a row falls into, and the leaves' values are looked up, so the plan has one step however
    many trees there are.
    """
    steps = F.from_json(F.lit(json.dumps(leaf_steps(model))), "array<array<double>>")
    leaves = vector_to_array(F.col("_leaves"))
    values = F.transform(leaves, lambda leaf, tree: F.get(F.get(steps, tree), leaf.cast("int")))
    from_here = F.array(F.lit(0.0) if start is None else start)
    # a few trees at a time, so that growing the array does not copy all of it for every tree
    some = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / TREES_AT_ONCE).cast("int")), lambda k: F.slice(values, k * TREES_AT_ONCE + 1, TREES_AT_ONCE))

    def add(so_far: Column, chunk: Column) -> Column:
        sums = F.aggregate(chunk, F.array(F.element_at(so_far, -1)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
        return F.concat(so_far, F.slice(sums, F.lit(2), F.size(chunk)))

    with_leaves = model.setLeafCol("_leaves").transform(df).drop("rawPrediction", "prediction", "probability")
    return with_leaves.withColumn("_margins", F.slice(F.aggregate(some, from_here, add), F.lit(2), F.size(values))).drop("_leaves")


def feature_importance(
    spark: SparkSession, model: GBTClassificationModel, features: Sequence[str], kind: str, fold: int = 0
) -> DataFrame:
    """``(feature, fold, importance)`` rows: ``gain`` or ``split`` counts of every feature, or ``used`` splits only."""
    if kind == "gain":
        gains = model.featureImportances.toArray().tolist()
        rows = [(f, fold, float(g)) for f, g in zip(features, gains)]
        return spark.createDataFrame(rows, "feature string, fold int, importance double")
    nodes = saved_nodes(spark, model).select(F.col("nodeData.split.featureIndex").alias("index"))
    splits = nodes.where("index >= 0").groupBy("index").agg(F.count(F.lit(1)).cast("double").alias("importance"))
    if kind == "split":
        names = spark.createDataFrame(list(enumerate(features)), "index int, feature string")
        splits = names.join(splits, "index", "left").fillna(0.0, ["importance"])
    else:
        names = F.array(*[F.lit(f) for f in features])
        splits = splits.withColumn("feature", names[F.col("index")])
    return splits.select("feature", F.lit(fold).alias("fold"), "importance")


def gbt_fit_predict(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    params: Mapping[str, object],
    importance: str = "split",
    categories: Mapping[str, int] | None = None,
) -> Fitted:
    """One model on all of train."""
    model = fit(assemble(train, features, categories=categories), params)
    return Fitted(score(model, assemble(test, features, categories=categories)), feature_importance(train.sparkSession, model, features, importance))


def stage_curve(staged: DataFrame, first: int = 0) -> DataFrame:
    """``fold, rounds, auc`` of every prefix, from rows with ``fold``, ``label`` and ``_margins`` after ``first`` rounds and on.

    All prefixes of all folds are scored in one pass.
    """
    stages = staged.select("fold", "label", F.posexplode("_margins")).select(
        # fold and rounds share one number, which has room for 2^32 of either
        F.shiftleft(F.col("fold").cast("long"), 32).bitwiseOR(F.col("pos").cast("long") + first + 1).alias("stage"),
        "label",
        F.col("col").alias("margin"),
    )
    return roc_auc(stages, score="margin", by="stage").select(
        F.shiftright("stage", 32).cast("int").alias("fold"),
        F.col("stage").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("rounds"),
        "auc",
    )


def patience_stop(curve: DataFrame, patience: int) -> DataFrame:
    """``fold, rounds, auc, last, stopped``: the best round of each fold before ``patience`` rounds bring no gain.

    ``last`` is the round at which patience is used up, or the last one there is; the first of equal rounds is the best,
    and an undefined AUC is worse than any other. A fold has as many rows as rounds.
    """
    area = F.coalesce("auc", F.lit(-1.0))
    order = Window.partitionBy("fold").orderBy("rounds")
    before, to_here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gains = F.coalesce(area > F.max(area).over(before), F.lit(True))
    best = curve.withColumn("_gain", F.when(gains, F.struct("rounds", "auc"))).withColumn("best", F.last("_gain", ignorenulls=True).over(to_here))
    used_up = F.col("rounds") - F.col("best.rounds") >= patience
    ends = best.withColumn("_stop", used_up).groupBy("fold").agg(
        F.min(F.when(F.col("_stop"), F.struct("rounds", "best"))).alias("stop"), F.max(F.struct("rounds", "best")).alias("end")
    )
    at = F.coalesce("stop", "end")
    return ends.select(
        "fold", at["best"]["rounds"].alias("rounds"), at["best"]["auc"].alias("auc"), at["rounds"].alias("last"), F.col("stop").isNotNull().alias("stopped")
    )


def early_stop(
    models: Sequence[GBTClassificationModel], folded: DataFrame, patience: int
) -> tuple[list[int], DataFrame]:
    """How many rounds each fold keeps: the best validation AUC before ``patience`` rounds without a gain.

    Returns the rounds per fold and the table ``(fold, rounds, auc)``.
    """
    staged = [tree_margins(m, folded.where(F.col("fold") == i)).select("fold", "label", "_margins") for i, m in enumerate(models)]
    curve = stage_curve(reduce(DataFrame.unionByName, staged))
    by_fold: dict[int, dict[int, float]] = {}
    for r in curve.collect():  # one row per fold and round
        by_fold.setdefault(r.fold, {})[r.rounds] = -1.0 if r.auc is None else r.auc
    return [_best_round(by_fold[i], patience) for i in range(len(models))], curve


def _best_round(auc: Mapping[int, float], patience: int) -> int:
    best = 1
    for rounds in sorted(auc):
        if auc[rounds] > auc[best]:
            best = rounds
        elif rounds - best >= patience:
            break
    return best


def fit_until_patience(
    train_of, folded: DataFrame, folds: int, params: Mapping[str, object], patience: int, parallelism: int = 4
) -> list[tuple[GBTClassificationModel, int]]:
    """A model per fold and the number of its trees to keep, at most ``params["maxIter"]``.

    Of fits of 8, 16, 32 and more rounds, those that patience outlasts are left out; the others follow one another until a
    fold's patience is used up. With one seed and one layout a shorter fit is the beginning of a longer one, so a validation
    row keeps its margin and only new trees are scored.
    All the fits together grow less than twice the trees of the last one.
    """
    limit = int(params["maxIter"])
    before, rounds = 0, FIRST_ROUNDS
    # patience is not used up before its own number of rounds and one more, so shorter fits could not end any fold
    while rounds <= patience:
        rounds *= 2
    rounds = min(rounds, limit)
    waiting = {i: folded.where(F.col("fold") == i).withColumn("_margin", F.lit(0.0)) for i in range(folds)}
    curves: dict[int, dict[int, float]] = {i: {} for i in range(folds)}
    done: dict[int, tuple[GBTClassificationModel, int]] = {}
    with ThreadPoolExecutor(min(parallelism, folds)) as pool:
        while waiting:
            active = sorted(waiting)
            models = dict(zip(active, pool.map(lambda i: fit(train_of(i), dict(params) | {"maxIter": rounds}), active)))
            new = {i: trees_between(models[i], before) for i in active}
            staged = [tree_margins(new[i], waiting[i], F.col("_margin")).drop("_margin") for i in active]
            stored = materialize(reduce(DataFrame.unionByName, staged), "margins")
            for r in stage_curve(stored, before).collect():  # one row per fold and new round
                curves[r.fold][r.rounds] = -1.0 if r.auc is None else r.auc
            for i in active:
                best, last = _best_round(curves[i], patience), max(curves[i])
                if last - best >= patience or _stopped(curves[i], best, patience) or rounds == limit:
                    done[i] = models[i], best
                    del waiting[i]
                else:
                    waiting[i] = stored.where(F.col("fold") == i).withColumn("_margin", F.element_at("_margins", -1)).drop("_margins")
            before, rounds = rounds, min(2 * rounds, limit)
    return [done[i] for i in range(folds)]


def _stopped(auc: Mapping[int, float], best: int, patience: int) -> bool:
    """Whether no round within ``patience`` after the best one is better, all of them known."""
    return best + patience in auc


class Prepared(NamedTuple):
    """Assembled rows, written once: train with its folds, one directory per fold, and test."""

    folded: DataFrame
    test: DataFrame
    features: list[str]
    folds: int

    def train_of(self, fold: int) -> DataFrame:
        return fold_split(self.folded, fold).where("NOT is_val")


def prepare_folds(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    folds: int = 10,
    seed: int = SEED,
    categories: Mapping[str, int] | None = None,
) -> Prepared:
    """What all fits over the same folds share."""
    assigned = stratified_folds(train.select(*KEYS), folds, seed).select(*[F.col(c).alias(f"_{c}") for c in KEYS[:2]], "fold")
    same_row = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEYS[:2]]
    folded = assemble(train.join(assigned, same_row), features, "fold", categories=categories)
    ready = materialize(assemble(test, features, categories=categories), "test")
    return Prepared(materialize(folded, "folds", "fold"), ready, list(features), folds)


def fit_folds(
    prepared: Prepared, params: Mapping[str, object], patience: int | None, parallelism: int = 4
) -> list[tuple[GBTClassificationModel, int | None]]:
    """A model per fold, and how many of its trees count where there is patience."""
    if patience:
        return fit_until_patience(prepared.train_of, prepared.folded, prepared.folds, params, patience, parallelism)
    with ThreadPoolExecutor(min(parallelism, prepared.folds)) as pool:
        return [(m, None) for m in pool.map(lambda i: fit(prepared.train_of(i), params), range(prepared.folds))]


def blended_test(prepared: Prepared, fitted: Sequence[tuple[GBTClassificationModel, int | None]]) -> DataFrame:
    """The folds' mean prediction for test, not computed yet."""
    on_test = [score(m, prepared.test, rounds).select(*KEYS, "probability") for m, rounds in fitted]
    return blend_folds(reduce(DataFrame.unionByName, on_test), KEYS)


def gbt_oof(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    params: Mapping[str, object],
    folds: int = 10,
    seed: int = SEED,
    patience: int | None = None,
    importance: str = "split",
    parallelism: int = 4,
    categories: Mapping[str, int] | None = None,
) -> OutOfFold:
    """A model per fold; out-of-fold predictions for train, the folds' mean prediction for test.

    The assembled folds are written once, one directory per fold, so a fold's training and validation
    sets are directory choices. Fits share the executors through ``parallelism`` driver threads.
    """
    prepared = prepare_folds(train, test, features, folds, seed, categories)
    fitted = fit_folds(prepared, params, patience, parallelism)
    spark = train.sparkSession
    with ThreadPoolExecutor(min(parallelism, folds)) as pool:
        per_fold = list(pool.map(lambda i: feature_importance(spark, fitted[i][0], features, importance, i), range(folds)))
    validation = [
        score(m, prepared.folded.where(F.col("fold") == i), rounds).select(*KEYS, "fold", "probability")
        for i, (m, rounds) in enumerate(fitted)
    ]
    oof = materialize(reduce(DataFrame.unionByName, validation), "oof")
    table = reduce(DataFrame.unionByName, per_fold)
    fold_auc = roc_auc(oof, by="fold")
    return OutOfFold(
        oof=oof,
        test=materialize(blended_test(prepared, fitted), "blended"),
        importance=importance_fold_join(table, folds) if importance == "used" else mean_importance(table),
        fold_auc=fold_auc,
        mean_auc=mean_fold_auc(fold_auc),
        oof_auc=roc_auc(oof),
        rounds=[m.getNumTrees if rounds is None else rounds for m, rounds in fitted],
    )
