from __future__ import annotations

from types import SimpleNamespace

import pytest

import spendcast.session as session
from spendcast.schema import TRANSACTION_SCHEMA
from spendcast.sources.sinks import dataset_profile, log_metrics, read_metrics, read_submission_template, write_submission
from spendcast.sources.transactions import read_transactions, star_transactions
from tests.conftest import SMALL, same_rows


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text(
        "extra,total,order_id,product_id,customer_id,country,order_date,quantity,price\n"
        "x,-3.5,1,2,3,France,2011-11-30 23:59:59,-1,3.5\n"
        "y,NaN,1,2,,Spain,2011-12-01 00:00:00,2,1.25\n"
    )
    df = read_transactions(spark, str(path))
    assert df.columns == [*TRANSACTION_SCHEMA.fieldNames(), "row_tag"]
    first, second = df.orderBy("order_date").collect()
    assert (first.total, first.country, str(first.order_date)) == (-3.5, "France", "2011-11-30 23:59:59")
    assert second.total is None and second.customer_id is None


def test_parquet_round_trip(spark, log, tmp_path):
    path = str(tmp_path / "log")
    columns = TRANSACTION_SCHEMA.fieldNames()
    log.select(*columns).write.parquet(path)
    read = read_transactions(spark, path, "parquet")
    assert same_rows(read.select(*columns), log.select(*columns))
    assert read.select("row_tag").distinct().count() == log.count()


def test_no_line_is_lost_in_the_star_join(spark, log):
    assert log.count() == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()


def test_star_join_reads_only_what_it_needs(spark):
    plan = star_transactions(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "c_acctbal" not in plan and "o_totalprice" not in plan


def test_submission_overwrites(spark, tmp_path):
    path = str(tmp_path / "out")
    for p in (0.1, 0.2):
        write_submission(spark.createDataFrame([(1, p)], "customer_id long, probability double"), path)
    assert [tuple(r) for r in read_submission_template(spark, path).collect()] == [(1, 0.2)]


def test_template_is_read_by_its_header(spark, tmp_path):
    path = tmp_path / "template.csv"
    path.write_text("note,probability,customer_id\nx,0.5,11\ny,,12\n")
    rows = read_submission_template(spark, str(path)).orderBy("customer_id").collect()
    assert [(r.customer_id, r.probability, r.note) for r in rows] == [(11, 0.5, "x"), (12, None, "y")]
    path.write_text("id,probability\n1,0.5\n")
    with pytest.raises(ValueError, match="customer_id"):
        read_submission_template(spark, str(path))


def test_metrics_append(spark, tmp_path):
    path = str(tmp_path / "metrics")
    df = spark.createDataFrame([("f1", 0.5)], "metric string, value double")
    log_metrics(df, path, "a")
    log_metrics(df, path, "b")
    assert sorted((r.run_id, r.name, r.value) for r in read_metrics(spark, path).collect()) == [("a", "f1", 0.5), ("b", "f1", 0.5)]


def test_profile(log):
    assert tuple(dataset_profile(log, ["order_id", "country"]).first()) == (log.count(), 2, "country")


class Conf:
    def __init__(self, **settings):
        self.settings = settings

    def get(self, key, default=None):
        return self.settings.get(key.replace(".", "_"), default)


class Context:
    def __init__(self, master):
        self.master, self.made = master, None

    def getCheckpointDir(self):
        return self.made

    def setCheckpointDir(self, path):
        self.made = path


def fake_session(master, **settings):
    return SimpleNamespace(conf=Conf(**settings), sparkContext=Context(master))


def test_scratch_folder_comes_from_the_session(spark):
    assert session.scratch_root(fake_session("yarn", spark_checkpoint_dir="hdfs:///shared/")) == "hdfs:///shared"
    root = session.scratch_root(spark)
    stored = session.materialize(spark.range(3), "three")
    assert all(f.startswith(f"file://{root.removeprefix('file:')}") for f in stored.inputFiles())


def test_a_local_session_makes_its_own_folder_once():
    local = fake_session("local[2]")
    assert session.scratch_root(local) == session.scratch_root(local)


def test_a_cluster_must_name_its_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(fake_session("spark://host:7077"))
