"""A large log is put in order part by part and worked off in passes, with the results of one pass."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spendcast.operators import features, running_totals
from spendcast.operators.ordered import CHUNK, SEQ, between_bounds
from spendcast.operators.running_totals import bytes_behind, order_log
from spendcast.plans import boosting
from spendcast.plans.feature_matrix import feature_engineering, snapshot_matrix
from spendcast.schema import LOG_ORDER
from spendcast.session import discard, freed, materialize, scratch_root
from tests.conftest import same_rows


@pytest.fixture(scope="module")
def purchases(spark, tmp_path_factory):
    """Orders with copies of lines, rows without customer, product or date, a day with many orders, a common product."""
    start, rows = datetime(2011, 1, 1), []
    for i in range(600):
        day = start + timedelta(days=150 if i % 5 == 0 else i * 7 % 330)
        customer = None if i % 97 == 3 else i * 31 % 37
        product = None if i % 89 == 5 else 1 if i % 3 == 0 else i * 17 % 53
        for line in range(1 + i % 3):
            price = round(i * 1.37 % 91 - 20, 4)
            row = (i // 2, line, product, i % 11, customer, f"c{i % 4}", None if i % 83 == 9 else day, float(i % 7), price, price * (i % 7))
            rows += [row] * (2 if i % 40 == 0 else 1)
    kinds = "order_id long, line_no int, product_id long, supplier_id long, customer_id long, country string, order_date timestamp_ntz, quantity double, price double, total double"
    path = str(tmp_path_factory.mktemp("log") / "log")
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def tables(spark):
    root = f"{scratch_root(spark)}/spendcast-{spark.sparkContext.applicationId}".removeprefix("file:")
    return {f.rsplit("-", 1)[0] + "/" + f for f in os.listdir(root)} if os.path.isdir(root) else set()


def in_parts(monkeypatch, log, n=4):
    monkeypatch.setattr(running_totals, "BYTES_AT_ONCE", -(-bytes_behind(log) // n))
    monkeypatch.setattr(features, "ROWS_PER_PASS", -(-log.count() // 2))


def test_log_is_ordered_part_by_part(spark, purchases, monkeypatch):
    plain = order_log(purchases, 8)
    before = tables(spark)
    in_parts(monkeypatch, purchases)
    ordered = order_log(purchases, 8)
    assert same_rows(plain.drop(SEQ, CHUNK), ordered.drop(SEQ, CHUNK))
    assert {t.split("/")[0] for t in tables(spark) - before} == {"ordered"}
    got = [tuple(r) for r in ordered.orderBy(SEQ).select(*LOG_ORDER).collect()]
    key = lambda row: tuple((v is not None, v) if v is not None else (False,) for v in row)
    assert got == sorted(got, key=key)
    assert ordered.select(SEQ).distinct().count() == len(got)
    assert ordered.where(F.shiftright(SEQ, 33) != F.col(CHUNK)).isEmpty()
    # rows of all parts are spread over chunks of their own
    assert ordered.select(CHUNK).distinct().count() > 4


def test_files_behind_a_table_are_what_counts(spark, purchases):
    """Not what a cached join is guessed to hold, nor rows without files."""
    files = bytes_behind(purchases)
    joined = purchases.join(purchases.withColumnRenamed("order_id", "other"), "line_no")
    assert 0 < files < 10**6 and bytes_behind(joined) == 2 * files
    assert bytes_behind(joined.where("line_no = 0").cache()) == 2 * files
    assert bytes_behind(spark.createDataFrame([(1,)], "x int")) == 0


def test_bounds_cut_every_row_once(spark, purchases):
    for cut in (between_bounds(purchases, "order_date", 5), between_bounds(purchases.where("order_date IS NULL"), "order_date", 3)):
        named = purchases.select(sum(F.when(c, 1).otherwise(0) for c in cut).alias("n"))
        assert named.where("n != 1").isEmpty()


def test_passes_give_the_features_of_one_pass(spark, purchases, monkeypatch):
    months = ["2011-06", "2011-09"]
    whole = features.customer_snapshot_features(order_log(purchases, 6), months, modes=["country"])
    expected = {(r.customer_id, r.year_month): r for r in whole.collect()}
    in_parts(monkeypatch, purchases)
    ordered = order_log(purchases, 6)
    before = tables(spark)
    got = features.customer_snapshot_features(ordered, months, modes=["country"])
    # neither rows with totals nor what enters chunks is left
    assert {t.split("/")[0] for t in tables(spark) - before} == {"matrix"}
    rows = got.collect()
    assert len(rows) == len(expected) and got.columns == whole.columns
    for r in rows:
        other = expected[r.customer_id, r.year_month]
        for name, a, b in zip(got.columns, r, other, strict=True):
            assert a == (pytest.approx(b, rel=1e-6, abs=1e-6) if isinstance(b, float) and name.endswith(("std", "skew")) else b), name


def test_matrix_in_passes_has_every_label(spark, purchases, monkeypatch):
    ordered = order_log(purchases, 6)
    whole = snapshot_matrix(ordered, "2011-09")
    expected = whole.select("customer_id", "year_month", "label", "order_id__nunique", "total__sum")
    in_parts(monkeypatch, purchases)
    matrix = snapshot_matrix(ordered, "2011-09")
    assert same_rows(expected, matrix)  # among them customers without a number
    stored = feature_engineering(ordered, "2011-09", impute=False)
    assert stored.train.count() + stored.test.count() == whole.count()


def test_one_folder_of_a_table_is_discarded(spark):
    df = spark.range(9).withColumn("p", (F.col("id") % 3).cast("int"))
    with freed(spark) as scratch:
        table = scratch.keep(materialize(df, "dealt", partition_by="p"))
        discard(table, "p=1")
        path = table.inputFiles()[0].split("/p=")[0].removeprefix("file:")
        assert sorted(f for f in os.listdir(path) if f.startswith("p=")) == ["p=0", "p=2"]
        discard(df, "p=0")  # was not written here
        assert table.where("p = 0").count() == 3


def test_fit_lets_go_of_the_shuffle_that_lays_out_rows(spark, monkeypatch):
    called = []
    rows = spark.createDataFrame([(i, "m", i % 2, float(i % 5)) for i in range(40)], "customer_id long, year_month string, label int, x double")

    class Jvm:
        class System:
            gc = staticmethod(lambda: called.append(1))

    class Session:
        _jvm = Jvm

    class Train:
        sparkSession = Session

    monkeypatch.setattr(boosting, "pinned", lambda _: boosting.assemble(rows, ["x"]))
    monkeypatch.setattr(boosting, "enough_bins", lambda _, params: params)
    assert boosting.fit(Train, {"maxIter": 1, "maxDepth": 1}).getNumTrees == 1 and called == [1]
