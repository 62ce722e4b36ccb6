"""Train and test matrices for one target month."""

from __future__ import annotations

from collections.abc import Mapping
from types import MappingProxyType
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcast.functions.calendar import month_offset
from spendcast.operators.features import customer_snapshot_features
from spendcast.operators.labels import generate_labels
from spendcast.operators.matrix import select_features, train_matrix_join
from spendcast.operators.preprocess import detect_categoricals, mark_gaps, nominal_codes, preprocess
from spendcast.operators.snapshots import SNAPSHOT
from spendcast.schema import SPEND_THRESHOLD


class Matrices(NamedTuple):
    train: DataFrame
    test: DataFrame
    features: list[str]
    # how many categories a feature has that is one of categories and not a number
    categories: Mapping[str, int] = MappingProxyType({})


def snapshot_matrix(
    ordered: DataFrame,
    month: str,
    time_term: int = 1,
    threshold: float = SPEND_THRESHOLD,
    universe: str = "through",
    **options,
) -> DataFrame:
    """Labels and features of the train month and the target month, in one plan.

    ``options`` go to :func:`customer_snapshot_features`.
    """
    months = [month_offset(month, time_term), month]
    labels = generate_labels(ordered, months, threshold, universe).drop("total")
    with_labels = lambda features, of_pass: train_matrix_join(of_pass(labels), features)
    return customer_snapshot_features(ordered, months, finish=with_labels, **options)


def feature_engineering(
    ordered: DataFrame,
    month: str,
    time_term: int = 1,
    threshold: float = SPEND_THRESHOLD,
    universe: str = "through",
    impute: bool = True,
    nominal: bool = False,
    **options,
) -> Matrices:
    """Train on the month ``time_term`` earlier, test on ``month``.

    Without ``impute``, gaps are filled below all values and marked, so that a model can tell them. With ``nominal``, string
    features are categories to the model; else their codes are numbers. ``options`` go to the features.
    The matrix is written once, partitioned by month; fitting medians and models reads it many times.
    """
    matrix = snapshot_matrix(ordered, month, time_term, threshold, universe, store=SNAPSHOT, **options)
    features = select_features(matrix)
    train = matrix.where(F.col(SNAPSHOT) == month_offset(month, time_term))
    test = matrix.where(F.col(SNAPSHOT) == month)
    sizes: dict[str, int] = {}
    if nominal:
        train, test, sizes = nominal_codes(train, test, detect_categoricals(train, features))
    train, test = preprocess(train, test, features, impute)
    if not impute:
        train, test, features = mark_gaps(train, test, features)
    return Matrices(train, test, features, sizes)
