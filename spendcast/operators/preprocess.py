"""Label encoding and exact median imputation, fitted as distributed jobs."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcast.operators.matrix import union_vocabulary
from spendcast.operators.ordered import order_rows, running_sums
from spendcast.schema import feature_column

# The sketch's rank error is one part in this number. A larger number narrows the bracket that is ranked
# exactly, but makes the sketches that tasks exchange larger.
ACCURACY = 2_000
MARGIN = 3.0 / ACCURACY


def detect_categoricals(df: DataFrame, features: Sequence[str]) -> list[str]:
    return [f for f in features if isinstance(df.schema[f].dataType, T.StringType)]


def label_codes(vocabulary: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: the 0-based rank of every distinct value, ranked chunk by chunk."""
    one = order_rows(vocabulary, [column]).withColumns({"all": F.lit(0), "one": F.lit(1).cast("bigint")})
    ranked = running_sums(one, {"all": {"rank": "one"}})
    return ranked.select(column, (F.col("rank") - 1).alias("code"))


def label_encode(train: DataFrame, test: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Replace a string column by codes fitted on train and test together; NULL stays NULL.

    The vocabulary stays a table: adaptive planning broadcasts it when it measures small and joins by
    shuffle, splitting hot values, when it does not.
    """
    codes = label_codes(union_vocabulary(train, test, column), column)

    def encode(df: DataFrame) -> DataFrame:
        coded = df.join(codes, [column], "left")
        return coded.select(*[F.col("code").alias(column) if c == column else F.col(c) for c in df.columns])

    return encode(train), encode(test)


def nominal_codes(
    train: DataFrame, test: DataFrame, columns: Sequence[str]
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Replace string columns by categories from 0 on, and say how many each has. Missing values are the last category."""
    sizes = {}
    for column in columns:
        known = union_vocabulary(train, test, column).count()
        coded = label_encode(train, test, column)
        train, test = (df.withColumn(column, F.coalesce(F.col(column), F.lit(known)).cast("double")) for df in coded)
        sizes[column] = known + 1
    return train, test, sizes


def mark_gaps(
    train: DataFrame, test: DataFrame, features: Sequence[str], keys: Sequence[str] = ("customer_id", "year_month")
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Fill missing features with a number below all others, and add columns that mark where train has gaps.

    A tree can so split gaps off as the lowest bin, or by the mark where the bin is too small to get a bound of its own.
    The number is the least value in train, less its size or one, whichever is more; 0 where train has none. Features
    missing in the same rows share one mark, named after the first of them: a checksum of the rows' keys tells. All of it
    is one aggregate over train.
    """
    row = F.xxhash64(*keys)
    found = train.agg(
        *[
            F.struct(
                F.min(f).cast("double").alias("low"),
                F.count_if(F.col(f).isNull()).alias("n"),
                F.bit_xor(F.when(F.col(f).isNull(), row)).alias("rows"),
            ).alias(f)
            for f in features
        ]
    ).first()
    low = {f: 0.0 if found[f].low is None else found[f].low - max(1.0, abs(found[f].low)) for f in features}
    first: dict[tuple[int, int], str] = {}
    for f in features:
        if found[f].n:
            first.setdefault((found[f].n, found[f].rows), f)
    marks = {feature_column(f, "missing"): f for f in first.values()}
    clashes = sorted(set(marks) & (set(train.columns) | set(test.columns)))
    if clashes:
        raise ValueError(f"columns have the names of marks: {', '.join(clashes)}")

    def marked(df: DataFrame) -> DataFrame:
        flags = {mark: F.col(f).isNull().cast("double") for mark, f in marks.items()}
        filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(low[f])) for f in features}
        return df.withColumns(flags).withColumns(filled)

    return marked(train), marked(test), [*features, *marks]


def median_fit(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Exact median of every feature, the mid-point of the two middle values.

    A sketch first brackets the middle ranks, with a margin three times its error bound. Values outside
    the bracket are then only counted, at its two ends, and those inside are ranked, so neither a task
    nor the driver ever holds a whole column. A feature whose bracket misses is ranked in full.
    ``df`` is read twice: pass a materialized table.
    """
    sketch = (
        df.unpivot([], list(features), "feature", "value")
        .groupBy("feature")
        .agg(F.percentile_approx("value", [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY).alias("bracket"))
    )
    brackets = {r.feature: tuple(r.bracket) for r in sketch.where("bracket IS NOT NULL").collect()}
    empty = [f for f in features if f not in brackets]
    if empty:
        raise ValueError(f"no median: every value is missing in {', '.join(empty)}")
    medians = _ranked_medians(df, brackets)
    missed = [f for f in features if not math.isfinite(medians[f])]
    if missed:
        medians |= _ranked_medians(df, {f: (-math.inf, math.inf) for f in missed})
    return medians


def _ranked_medians(df: DataFrame, brackets: Mapping[str, tuple[float, float]]) -> dict[str, float]:
    def clamped(feature: str) -> str:
        low, high = brackets[feature]
        return (
            f"CASE WHEN `{feature}` < double('{low!r}') THEN double('-Infinity') "
            f"WHEN `{feature}` > double('{high!r}') THEN double('Infinity') ELSE double(`{feature}`) END AS `{feature}`"
        )

    # equal values meet in one row with their count, before and after the shuffle
    counted = (
        df.selectExpr(*[clamped(f) for f in brackets])
        .unpivot([], list(brackets), "feature", "value")
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    # all features are ranked at once, chunk by chunk: the values of one feature spread over as many tasks as they need
    counted = order_rows(counted, ["feature", "value"])
    sizes = counted.groupBy("feature").agg(F.sum("copies").alias("n"))  # one row per feature
    placed = running_sums(counted, {"feature": {"last": "copies"}}).join(sizes, "feature")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("last") - F.col("copies") <= rank) & (rank < F.col("last")), F.col("value")))

    middle = placed.groupBy("feature").agg(
        ((value_at(F.expr("(n - 1) div 2")) + value_at(F.expr("n div 2"))) / 2).alias("median")
    )
    return {r.feature: r.median for r in middle.collect()}


def median_impute(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """One constant per feature, so the fill is part of the scan and joins nothing."""
    return df.fillna(dict(medians))


def preprocess(
    train: DataFrame, test: DataFrame, features: Sequence[str], impute: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Encode the string features, then fill missing features with the train medians."""
    for column in detect_categoricals(train, features):
        # a code may be missing and filled with a median between two codes
        train, test = (df.withColumn(column, F.col(column).cast("double")) for df in label_encode(train, test, column))
    if impute:
        medians = median_fit(train, features)
        train, test = median_impute(train, medians), median_impute(test, medians)
    return train, test
