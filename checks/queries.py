"""One entry per operator; each reads the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcast.functions.calendar import (
    derive_time_keys,
    filter_before_snapshot,
    filter_month,
    filter_through_month,
    month_offset_column,
)
from spendcast.functions.scoring import binarize, clip_probability, fill_missing_zero, threshold_label
from spendcast.functions.stats import name_aggregates
from spendcast.operators.features import (
    customer_snapshot_features,
    snapshot_approx_distinct_counts,
    snapshot_distinct_counts,
    snapshot_modes,
    statistics_by_states,
)
from spendcast.operators.folds import (
    blend_folds,
    fold_split,
    importance_fold_join,
    mean_fold_auc,
    mean_importance,
    stratified_folds,
)
from spendcast.operators.labels import (
    customer_universe,
    generate_label,
    generate_labels,
    label_sorted,
    label_universe_join,
    monthly_customer_total,
)
from spendcast.operators.matrix import (
    attach_predictions,
    previous_month_join,
    rename_previous_total,
    select_features,
    test_matrix_join,
    train_matrix_join,
    union_vocabulary,
)
from spendcast.operators.metrics import classification_report, roc_auc, threshold_scores
from spendcast.operators.mode import feat_mode
from spendcast.operators.preprocess import (
    detect_categoricals,
    label_encode,
    mark_gaps,
    median_fit,
    median_impute,
    nominal_codes,
    preprocess,
)
from spendcast.operators.running_totals import CUSTOMER_ROW, order_log, running_totals
from spendcast.operators.snapshots import snapshot_months, snapshot_range_join, tag_snapshot, union_snapshots
from spendcast.plans.baseline import baseline_no_ml
from spendcast.plans.boosting import (
    assemble,
    early_stop,
    feature_importance,
    fit,
    gbt_fit_predict,
    gbt_oof,
    patience_stop,
    stage_curve,
)
from spendcast.plans.feature_matrix import Matrices, feature_engineering, snapshot_matrix
from spendcast.plans.jobs import predict, validate
from spendcast.plans.profiles import PROFILES, SEARCH_SPACE, gbt_params
from spendcast.plans.tuning import best_trial, search_space, tune
from spendcast.schema import RUNNING_KEYS, TRANSACTION_SCHEMA, VALUES, running_column
from spendcast.session import configure, materialize, scratch_path
from spendcast.sources.sinks import (
    dataset_profile,
    log_metrics,
    materialize_with_profile,
    read_metrics,
    read_submission_template,
    write_submission,
)
from spendcast.sources.transactions import event_transactions, read_transactions, star_transactions

MONTH = "1996-02"
PREVIOUS = "1996-01"
# The month that ends the log: a snapshot of it covers every earlier row.
LAST, BEFORE_LAST = "2001-08", "2001-07"
SNAPSHOTS = [PREVIOUS, MONTH, LAST]
# Half-years over the whole log.
HALF_YEARS = [f"{y}-{m}" for y in range(1995, 2002) for m in ("01", "07")][1:]
# Staged predictions: what the last so many months before LAST say about it; rounds without a gain that are waited for.
STAGES, PATIENCE = 60, 5
FOLDS = 5
# Small models: these entries check that the jobs run, not how well they predict.
QUICK = {"maxDepth": 2, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.3", "stepSize": 0.1}
ROUNDS = 3

ROW = ["order_id", "line_no", "product_id", "supplier_id", "customer_id", "country", "order_date"]
BASE_STATISTICS = ("mean", "max", "min", "sum", "count", "std", "skew")

Query = Callable[[SparkSession, str], DataFrame]


def tx(spark: SparkSession, folder: str) -> DataFrame:
    """The log with four decimals, in which two engines agree: a quotient has no tie of rounding at six decimals."""
    log = star_transactions(configure(spark), folder)
    price = F.round(F.col("price").cast("decimal(18,6)"), 4).cast("double")
    return log.withColumns({"price": price, "total": F.round("total", 4)})


def rounded_events(spark: SparkSession, folder: str) -> DataFrame:
    return event_transactions(configure(spark), folder).withColumns({v: F.round(v, 4) for v in VALUES})


def log_through(spark: SparkSession, folder: str, month: str) -> DataFrame:
    """The ordered log a target month can see: later rows would only be ordered to be dropped."""
    return order_log(filter_through_month(tx(spark, folder), month))


def rounded(df: DataFrame) -> DataFrame:
    """Second and third moments agree between engines up to noise; everything else is exact."""
    places = {c: places_of(c) for c in df.columns if places_of(c) is not None}
    return df.withColumns({c: F.round(c, p) for c, p in places.items()})


def places_of(column: str) -> int | None:
    if column.endswith("__skew"):
        return 4
    if column.endswith("__std"):
        return 0 if column.startswith("cumsum") else 5
    return None


# ---- sources and sinks


def read_transactions_query(spark, folder):
    path = scratch_path(spark, "csv")
    tx(spark, folder).select(*TRANSACTION_SCHEMA.fieldNames()).write.option("header", True).csv(path)
    return read_transactions(spark, path).drop("row_tag")


def transactions_query(spark, folder):
    return tx(spark, folder).select(*ROW, "quantity", "price", "total")


def submission_template(spark, folder):
    path = scratch_path(spark, "template")
    customers = customer_universe(tx(spark, folder), LAST)
    write_submission(customers.withColumn("probability", F.lit(0.0)), path)
    return read_submission_template(spark, path)


def observed_profile_query(spark, folder):
    """The profile of the log, and its gaps by column, as counted by the write of it."""
    profile = materialize_with_profile(tx(spark, folder), "log", TRANSACTION_SCHEMA.fieldNames())[1]
    gaps = F.aggregate(F.map_values("n_missing"), F.lit(0).cast("long"), lambda s, x: s + x)
    return profile.withColumn("n_missing", gaps)


def attach_predictions_query(spark, folder):
    return attach_predictions(submission_template(spark, folder), baseline_no_ml(tx(spark, folder), MONTH))


def write_submission_query(spark, folder):
    path = scratch_path(spark, "submission")
    write_submission(baseline_no_ml(tx(spark, folder), MONTH).select("customer_id", "probability"), path)
    return read_submission_template(spark, path)


def log_metrics_query(spark, folder):
    path = scratch_path(spark, "metrics")
    for month in (PREVIOUS, MONTH):
        log_metrics(classification_report(baseline_no_ml(tx(spark, folder), month)), path, f"baseline-{month}")
    return read_metrics(spark, path).select("run_id", "name", "value")


# ---- projections and filters


def month_offset_query(spark, folder):
    months = tx(spark, folder).select(F.date_format("order_date", "yyyy-MM").alias("ym")).distinct()
    return months.select("ym", *[month_offset_column(F.col("ym"), n).alias(f"minus_{n}") for n in (1, 2, 13)])


def select_features_query(spark, folder):
    labels = generate_label(tx(spark, folder), MONTH)
    return labels.select(*select_features(labels))


def name_aggregates_query(spark, folder):
    wanted = name_aggregates(VALUES, ("max", "count"), separator="-")
    return tx(spark, folder).groupBy("customer_id").agg(*wanted)


def scored(spark, folder) -> DataFrame:
    return baseline_no_ml(tx(spark, folder), MONTH)


def monthly_totals_filled(spark, folder):
    labels = label_universe_join_query(spark, folder)
    return labels.select("customer_id", fill_missing_zero(F.col("total")).alias("total"))


# ---- joins


def label_universe_join_query(spark, folder):
    log = tx(spark, folder)
    return label_universe_join(customer_universe(log, MONTH), monthly_customer_total(log), MONTH)


def by_customer(log: DataFrame) -> DataFrame:
    """Rows brought together by customer before statistics, whose states are wider than rows; adaptive planning splits what is skewed."""
    return log.hint("rebalance", "customer_id")


def base_statistics(df: DataFrame, statistics=BASE_STATISTICS, keys=("customer_id", "year_month")) -> DataFrame:
    return df.groupBy(*keys).agg(*name_aggregates(VALUES, statistics))


def train_matrix_join_query(spark, folder):
    log = tx(spark, folder)
    labels = generate_labels(log, [PREVIOUS, MONTH]).drop("total")
    features = base_statistics(snapshot_range_join(by_customer(log), [PREVIOUS, MONTH]), ("sum", "count"))
    return train_matrix_join(labels, features)


def test_matrix_join_query(spark, folder):
    log = tx(spark, folder)
    features = base_statistics(tag_snapshot(log, MONTH), ("sum", "count"))
    return test_matrix_join(generate_label(log, MONTH).drop("total"), features)


def snapshot_range_join_query(spark, folder):
    return base_statistics(snapshot_range_join(by_customer(tx(spark, folder)), SNAPSHOTS), ("sum", "count", "min", "max"))


def union_snapshots_query(spark, folder):
    return base_statistics(union_snapshots(tx(spark, folder), SNAPSHOTS), ("sum", "count", "min", "max"))


def previous_month_join_query(spark, folder):
    log = tx(spark, folder)
    return previous_month_join(generate_label(log, MONTH), generate_label(log, PREVIOUS))


def fold_importances(spark, folder) -> DataFrame:
    """A table shaped like model importances: each product's large order lines per fold of customers."""
    large = tx(spark, folder).where(F.col("quantity") >= 25)
    feature = F.col("product_id").cast("string").alias("feature")
    fold = F.pmod("customer_id", F.lit(FOLDS)).cast("int").alias("fold")
    return large.groupBy(feature, fold).agg(F.count(F.lit(1)).cast("double").alias("importance"))


# ---- aggregates


def statistic(*statistics: str) -> Query:
    def run(spark, folder):
        return rounded(base_statistics(by_customer(tx(spark, folder)), statistics, ("customer_id",)))

    return run


def fold_predictions(spark, folder) -> DataFrame:
    """One prediction per customer, month and fold: the baseline of several months, folds by customer."""
    log = tx(spark, folder)
    per_month = [baseline_no_ml(log, m) for m in (MONTH, "1998-01", "2001-07")]
    folds = [df.withColumn("month", F.lit(i)) for i, df in enumerate(per_month)]
    everything = folds[0].unionByName(folds[1]).unionByName(folds[2])
    return everything.withColumn("fold", F.pmod("customer_id", F.lit(FOLDS)).cast("int"))


def customer_snapshot_features_query(spark, folder):
    return rounded(customer_snapshot_features(order_log(tx(spark, folder)), SNAPSHOTS))


def snapshot_states_query(spark, folder):
    """Statistics of the base values at many snapshots, each row aggregated once."""
    rows = tx(spark, folder).withColumn(CUSTOMER_ROW, F.lit(1).cast("bigint"))
    return rounded(statistics_by_states(rows, HALF_YEARS, VALUES))


def distinct_counts_query(spark, folder):
    return snapshot_distinct_counts(tx(spark, folder), SNAPSHOTS)


def approx_distinct_counts_query(spark, folder):
    return snapshot_approx_distinct_counts(tx(spark, folder), HALF_YEARS, ["product_id", "country", "order_date_year"])


def snapshot_modes_query(spark, folder):
    return snapshot_modes(tx(spark, folder), HALF_YEARS, ["product_id", "supplier_id", "country"])


# ---- running totals


def running_total_query(key: str) -> Query:
    def run(spark, folder):
        totals = running_totals(order_log(tx(spark, folder)), [key])
        return totals.select(*ROW, "quantity", "total", *[running_column(v, key) for v in VALUES])

    return run


def hourly_events_query(spark, folder):
    totals = running_totals(order_log(rounded_events(spark, folder)), ["order_date_hour"])
    return totals.select(
        F.col("order_id").alias("event_id"), "order_date_hour", running_column("total", "order_date_hour")
    )


# ---- preprocessing


def label_encode_query(spark, folder):
    log = tx(spark, folder).select(*ROW)
    train, test = filter_before_snapshot(log, "1998-01"), log
    coded = label_encode(train, test, "country")
    return coded[0].withColumn("part", F.lit("train")).unionByName(coded[1].withColumn("part", F.lit("test")))


def union_vocabulary_query(spark, folder):
    log = tx(spark, folder)
    return union_vocabulary(filter_before_snapshot(log, MONTH), log, "country")


def small_matrix(spark, folder) -> Matrices:
    """Labels with the statistics of the three base values: enough columns with gaps to fill."""
    log = tx(spark, folder)
    months = [BEFORE_LAST, LAST]
    features = base_statistics(snapshot_range_join(by_customer(log), months))
    matrix = train_matrix_join(generate_labels(log, months).drop("total"), features)
    stored = materialize(matrix, "matrix", partition_by="year_month")
    train, test = (stored.where(F.col("year_month") == m) for m in months)
    return Matrices(train, test, select_features(matrix))


def median_fit_query(spark, folder):
    m = small_matrix(spark, folder)
    rows = list(median_fit(m.train, m.features).items())
    medians = spark.createDataFrame(rows, "feature string, median double")
    # deviations carry engine noise in their last digits
    return medians.select("feature", F.round("median", 4).alias("median"))


def median_impute_query(spark, folder):
    m = small_matrix(spark, folder)
    medians = median_fit(m.train, m.features)
    return rounded(median_impute(m.train, medians).unionByName(median_impute(m.test, medians)))


def imputed_small(spark, folder) -> Matrices:
    m = small_matrix(spark, folder)
    medians = median_fit(m.train, m.features)
    return Matrices(median_impute(m.train, medians), median_impute(m.test, medians), m.features)


def feature_engineering_query(month: str) -> Query:
    def run(spark, folder):
        m = feature_engineering(log_through(spark, folder, month), month)
        return rounded(m.train.unionByName(m.test))

    return run


def snapshot_matrix_query(spark, folder):
    return rounded(snapshot_matrix(log_through(spark, folder, LAST), LAST))


def detect_categoricals_query(spark, folder):
    """The string columns of the log with its time keys, and how many values each has."""
    log = derive_time_keys(tx(spark, folder))
    columns = detect_categoricals(log, log.columns)
    long = log.unpivot([], columns, "column_name", "value")
    return long.distinct().groupBy("column_name").agg(F.count("value").alias("n_values"))


def mark_gaps_query(spark, folder):
    """Two early months, in which customers without a history, or with few rows, leave gaps."""
    log = tx(spark, folder)
    features = base_statistics(snapshot_range_join(by_customer(log), [PREVIOUS, MONTH]))
    matrix = train_matrix_join(generate_labels(log, [PREVIOUS, MONTH]).drop("total"), features)
    stored = materialize(matrix, "matrix", partition_by="year_month")
    parts = [stored.where(F.col("year_month") == m) for m in (PREVIOUS, MONTH)]
    train, test, _ = mark_gaps(*parts, select_features(matrix))
    return rounded(train.unionByName(test))


def nominal_codes_query(spark, folder):
    """The commonest country of each customer before two months, missing for customers without a history."""
    log = tx(spark, folder)
    homes = snapshot_modes(log, [PREVIOUS, MONTH], ["country"])
    matrix = train_matrix_join(generate_labels(log, [PREVIOUS, MONTH]).drop("total"), homes)
    parts = [matrix.where(F.col("year_month") == m) for m in (PREVIOUS, MONTH)]
    train, test, sizes = nominal_codes(*parts, ["country__mode"])
    return train.unionByName(test).withColumn("n_categories", F.lit(sizes["country__mode"]))


def preprocess_query(spark, folder):
    """Encoding and filling together, on a matrix with one string feature."""
    log = tx(spark, folder)
    rows = snapshot_range_join(by_customer(log), [BEFORE_LAST, LAST])
    homes = rows.groupBy("customer_id", "year_month").agg(F.max("country").alias("country"))
    features = base_statistics(rows).join(homes, ["customer_id", "year_month"])
    matrix = train_matrix_join(generate_labels(log, [BEFORE_LAST, LAST]).drop("total"), features)
    stored = materialize(matrix, "matrix", partition_by="year_month")
    parts = [stored.where(F.col("year_month") == m) for m in (BEFORE_LAST, LAST)]
    train, test = preprocess(*parts, select_features(matrix))
    return rounded(train.unionByName(test))


# ---- models


def within_bounds(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``in_range`` in place of a fitted number, which no SQL can state: whether it lies between 0 and 1."""
    return df.withColumn("in_range", F.coalesce(F.col(column).between(0.0, 1.0), F.lit(False))).drop(column)


def quick_params() -> dict[str, object]:
    return gbt_params({}, ROUNDS) | QUICK


def stratified_folds_query(spark, folder):
    return stratified_folds(generate_label(tx(spark, folder), MONTH), 10).select("customer_id", "label", "fold")


def fold_split_query(spark, folder):
    folds = stratified_folds(generate_label(tx(spark, folder), MONTH), 10)
    return fold_split(folds, 3).groupBy("is_val", "label").agg(F.count(F.lit(1)).alias("n"))


def gbt_fit_predict_query(spark, folder):
    m = imputed_small(spark, folder)
    return within_bounds(gbt_fit_predict(m.train, m.test, m.features, quick_params()).predictions, "probability")


def oof_of(spark, folder, **options):
    m = imputed_small(spark, folder)
    return gbt_oof(m.train, m.test, m.features, quick_params(), folds=3, **options)


def early_stop_query(spark, folder):
    m = imputed_small(spark, folder)
    folded = materialize(assemble(stratified_folds(m.train, 3), m.features, "fold"), "folds", "fold")
    models = [fit(fold_split(folded, i).where("NOT is_val"), quick_params()) for i in range(3)]
    return within_bounds(early_stop(models, folded, patience=2)[1], "auc")


def staged_predictions(spark, folder) -> DataFrame:
    """``fold, label, _margins``: a customer's order lines of the last month, of the last two, and so on, as rounds."""
    log = filter_before_snapshot(tx(spark, folder), LAST)
    ago = F.months_between(F.lit(f"{LAST}-01").cast("date"), F.trunc("order_date", "month")).cast("int")
    counted = log.withColumn("ago", ago).where(F.col("ago") <= STAGES).groupBy("customer_id", "ago").agg(F.count(F.lit(1)).alias("n"))
    # a customer's counts meet in one task first: sixty sums of each are wider than the few counts they are made of
    sums = [F.sum(F.when(F.col("ago") <= k, F.col("n")).otherwise(0)).cast("double") for k in range(1, STAGES + 1)]
    per_customer = counted.repartition("customer_id").groupBy("customer_id").agg(F.array(*sums).alias("_sums"))
    through = generate_label(tx(spark, folder), BEFORE_LAST).join(per_customer, "customer_id", "left")
    margins = F.coalesce("_sums", F.array_repeat(F.lit(0.0), STAGES))
    fold = F.pmod("customer_id", F.lit(FOLDS)).cast("int").alias("fold")
    return through.select(fold, "label", margins.alias("_margins"))


def patience_stop_query(spark, folder):
    return patience_stop(stage_curve(staged_predictions(spark, folder)), PATIENCE)


def feature_importance_query(spark, folder):
    m = imputed_small(spark, folder)
    model = fit(assemble(m.train, m.features), quick_params())
    gains = feature_importance(spark, model, m.features, "gain")
    whole = gains.agg((F.abs(F.sum("importance") - 1.0) < 1e-9).alias("sums_to_one"))  # one row
    return within_bounds(gains.join(whole), "importance")


def split_importance_query(spark, folder):
    """Mean splits of every feature: whole numbers over the folds, some of them above 0, at most all nodes of all trees."""
    splits = oof_of(spark, folder, importance="split").importance
    most = ROUNDS * (2 ** int(QUICK["maxDepth"]) - 1)
    thirds = F.abs(3 * F.col("importance") - F.round(3 * F.col("importance"))) < 1e-9
    used = splits.agg((F.sum("importance") > 0).alias("any_used"), (F.sum("importance") <= most).alias("fits_trees"))  # one row
    return splits.join(used).withColumn("whole", thirds).drop("importance")


def param_profiles_query(spark, folder):
    """A short fit with the tuned parameters of each profile, and its AUC on the test month."""
    m = imputed_small(spark, folder)
    scored_by = [
        gbt_fit_predict(m.train, m.test, m.features, gbt_params(variants["tuned"], ROUNDS))
        .predictions.withColumn("profile", F.lit(profile))
        for profile, variants in PROFILES.items()
    ]
    return within_bounds(roc_auc(scored_by[0].unionByName(scored_by[1]).unionByName(scored_by[2]), by="profile"), "auc")


def search_space_query(spark, folder):
    """The draws of all profiles, for as many trials as the data has nations."""
    trials = spark.read.parquet(f"{folder}/nation.parquet").count()
    drawn = [
        search_space(spark, profile, trials).select(F.lit(profile).alias("profile"), "trial", F.explode("params").alias("name", "value"))
        for profile in SEARCH_SPACE
    ]
    table = drawn[0].unionByName(drawn[1]).unionByName(drawn[2])
    return table.select("profile", "trial", "name", F.round("value", 9).alias("value"))


def tune_query(spark, folder):
    trials = tune(imputed_small(spark, folder), "cat", n_trials=2, folds=2, max_rounds=2, overrides={"maxDepth": 2})
    return within_bounds(trials.select("trial", "val_auc"), "val_auc")


def best_trial_query(spark, folder):
    """Whether the best trial is the first of those that no other trial beats."""
    trials = materialize(tune(imputed_small(spark, folder), "xgb", n_trials=2, folds=2, max_rounds=2, overrides={"maxDepth": 2}), "trials")
    ahead = trials.select(F.col("trial").alias("other"), F.col("val_auc").alias("other_auc"))
    beaten_by = (F.col("other_auc") > F.col("val_auc")) | ((F.col("other_auc") == F.col("val_auc")) & (F.col("other") < F.col("trial")))
    best = best_trial(trials)
    return best.join(ahead, beaten_by, "left").agg(F.count("trial").alias("n_best"), F.count("other").alias("n_better"))  # a row per trial


def validate_query(spark, folder):
    """All folds and features with the profile's own parameters; its own patience ends the rounds."""
    ordered = log_through(spark, folder, MONTH)
    return within_bounds(validate(ordered, MONTH, "xgb").report, "value")


def predict_query(spark, folder):
    ordered = log_through(spark, folder, MONTH)
    template = customer_universe(ordered, MONTH)
    path = scratch_path(spark, "submission")
    predict(ordered, MONTH, "xgb", template, path)
    return within_bounds(read_submission_template(spark, path), "probability")


def queries() -> dict[str, Query]:
    simple: dict[str, Query] = {
        # sources and sinks
        "read_transactions": read_transactions_query,
        "transactions": transactions_query,
        "read_submission_template": submission_template,
        "write_submission": write_submission_query,
        "log_metrics": log_metrics_query,
        "dataset_profile": lambda s, d: dataset_profile(tx(s, d), TRANSACTION_SCHEMA.fieldNames()),
        "observed_profile": observed_profile_query,
        # projections and filters
        "derive_time_keys": lambda s, d: derive_time_keys(tx(s, d).select(*ROW)),
        "month_offset": month_offset_query,
        "filter_through_month": lambda s, d: filter_through_month(tx(s, d), MONTH).select(*ROW, "total"),
        "filter_month": lambda s, d: filter_month(tx(s, d), MONTH).select(*ROW, "total"),
        "filter_before_snapshot": lambda s, d: filter_before_snapshot(tx(s, d), MONTH).select(*ROW, "total"),
        "select_features": select_features_query,
        "rename_previous_total": lambda s, d: rename_previous_total(generate_label(tx(s, d), PREVIOUS)),
        "name_aggregates": name_aggregates_query,
        "tag_snapshot": lambda s, d: tag_snapshot(tx(s, d), LAST).select(*ROW, "year_month"),
        "threshold_label": lambda s, d: monthly_customer_total(tx(s, d)).withColumn(
            "label", threshold_label(F.col("total"))
        ),
        "fill_missing_zero": monthly_totals_filled,
        "clip_probability": lambda s, d: monthly_customer_total(tx(s, d)).withColumn(
            "probability", clip_probability(F.col("total"))
        ),
        "binarize": lambda s, d: scored(s, d).withColumn("predicted", binarize(F.col("probability"))),
        # joins
        "label_universe_join": label_universe_join_query,
        "train_matrix_join": train_matrix_join_query,
        "test_matrix_join": test_matrix_join_query,
        "snapshot_range_join": snapshot_range_join_query,
        "union_snapshots": union_snapshots_query,
        "previous_month_join": previous_month_join_query,
        "attach_predictions": attach_predictions_query,
        "importance_fold_join": lambda s, d: importance_fold_join(fold_importances(s, d), FOLDS),
        # aggregates
        "monthly_customer_total": lambda s, d: monthly_customer_total(tx(s, d)),
        "feat_mean": statistic("mean"),
        "feat_max_min": statistic("max", "min"),
        "feat_sum": statistic("sum"),
        "feat_count": statistic("count"),
        "feat_std": statistic("std"),
        "feat_skew": statistic("skew"),
        "feat_nunique": distinct_counts_query,
        "feat_mode": lambda s, d: feat_mode(tx(s, d), "customer_id", "product_id"),
        "snapshot_modes": snapshot_modes_query,
        "approx_distinct_counts": approx_distinct_counts_query,
        "customer_snapshot_features": customer_snapshot_features_query,
        "snapshot_states": snapshot_states_query,
        "mean_fold_auc": lambda s, d: mean_fold_auc(roc_auc(fold_predictions(s, d), by="fold")),
        "blend_folds": lambda s, d: blend_folds(fold_predictions(s, d)),
        "mean_importance": lambda s, d: mean_importance(fold_importances(s, d)),
        # distinct, sort, vocabulary
        "customer_universe": lambda s, d: customer_universe(tx(s, d), MONTH),
        "snapshot_months": lambda s, d: snapshot_months(generate_labels(tx(s, d), SNAPSHOTS)),
        "label_sorted": lambda s, d: label_sorted(generate_label(tx(s, d), MONTH)),
        "union_vocabulary": union_vocabulary_query,
        # preprocessing
        "label_encode": label_encode_query,
        "median_fit": median_fit_query,
        "median_impute": median_impute_query,
        "detect_categoricals": detect_categoricals_query,
        "preprocess": preprocess_query,
        "mark_gaps": mark_gaps_query,
        "nominal_codes": nominal_codes_query,
        "snapshot_matrix": snapshot_matrix_query,
        "feature_engineering": feature_engineering_query(MONTH),
        "feature_engineering_whole_log": feature_engineering_query(LAST),
        # labels and baseline
        "generate_label": lambda s, d: generate_label(tx(s, d), MONTH),
        "generate_label_before": lambda s, d: generate_label(tx(s, d), MONTH, universe="before"),
        "generate_labels": lambda s, d: generate_labels(tx(s, d), SNAPSHOTS),
        "baseline_no_ml": lambda s, d: baseline_no_ml(tx(s, d), MONTH),
        # metrics
        "threshold_scores": lambda s, d: threshold_scores(scored(s, d)),
        "roc_auc": lambda s, d: roc_auc(scored(s, d)),
        "auc_per_fold": lambda s, d: roc_auc(fold_predictions(s, d), by="fold"),
        "auc_oof": lambda s, d: roc_auc(fold_predictions(s, d)),
        "classification_report": lambda s, d: classification_report(scored(s, d)),
        # folds and models
        "stratified_folds": stratified_folds_query,
        "fold_split": fold_split_query,
        "gbt_fit_predict": gbt_fit_predict_query,
        "gbt_oof": lambda s, d: within_bounds(oof_of(s, d).oof, "probability"),
        "gbt_oof_early_stop": lambda s, d: within_bounds(oof_of(s, d, patience=2).test, "probability"),
        "early_stop": early_stop_query,
        "patience_stop": patience_stop_query,
        "feature_importance": feature_importance_query,
        "split_importance": split_importance_query,
        "param_profiles": param_profiles_query,
        # tuning and jobs
        "search_space": search_space_query,
        "tune": tune_query,
        "best_trial": best_trial_query,
        "validate": validate_query,
        "predict": predict_query,
    }
    names = {"customer_id": "cust", "product_id": "prod", "order_id": "order"}
    for key in RUNNING_KEYS:
        simple[f"cumsum_by_{names.get(key, key.removeprefix('order_date_'))}"] = running_total_query(key)
    simple["cumsum_by_hour_events"] = hourly_events_query
    return simple
