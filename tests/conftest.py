from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from spendcast.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(scope="session")
def log(spark):
    from spendcast.sources.transactions import star_transactions

    return star_transactions(spark, SMALL).cache()


@pytest.fixture(scope="session")
def ordered(log):
    from spendcast.operators.running_totals import order_log

    return order_log(log)


@pytest.fixture(scope="session")
def purchases(spark):
    """Refunds, totals at and around the threshold, a late joiner, and a row without a customer."""
    rows = [
        (1, "2011-10-05 10:00:00", 200.0),
        (1, "2011-11-02 09:00:00", 300.0),
        (2, "2011-10-20 00:00:00", -50.0),
        (2, "2011-11-03 12:30:00", 300.01),
        (3, "2011-10-31 23:59:59", 900.0),
        (3, "2011-11-01 00:00:00", -5.0),
        (4, "2011-11-30 23:59:59", 400.0),
        (5, "2011-12-01 00:00:00", 999.0),
        (6, "2011-09-01 08:00:00", 10.0),
        (None, "2011-11-05 08:00:00", 1000.0),
    ]
    df = spark.createDataFrame(rows, "customer_id long, order_date string, total double")
    return df.withColumn("order_date", df.order_date.cast("timestamp_ntz"))


def same_rows(left, right) -> bool:
    right = right.select(*left.columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
