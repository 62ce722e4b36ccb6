from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spendcast.operators.features import customer_snapshot_features
from spendcast.operators.ordered import CHUNK, PART, SEQ, order_rows, parted, running_sums
from spendcast.operators.running_totals import order_log, running_totals, running_totals_by_window
from spendcast.schema import LOG_ORDER, ROW_TAG, RUNNING_COLUMNS
from tests.conftest import same_rows


def skewed_rows(n=600):
    """A third of the rows share one key, and a third are copies of one row."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append((50, 1, "hot", 2.0))
        elif i % 3 == 1:
            rows.append((rng.randrange(100), rng.randrange(40), "hot", float(rng.randrange(-50, 50))))
        else:
            key = rng.choice([None, "a", "b", "c"])
            rows.append((rng.randrange(100), rng.randrange(40), key, rng.choice([None, 1.0, 3.0, -4.0])))
    return [(*r, tag) for tag, r in enumerate(rows)]


@pytest.mark.parametrize("chunks", [1, 3, 16])
def test_running_sums_match_brute_force(spark, chunks):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "t int, u int, k string, v double, tag int").repartition(5)
    result = running_sums(order_rows(df, ["t", "u", "k", "v", "tag"], chunks), {"k": {"by_k": "v"}, "u": {"by_u": "v"}})
    got = {r.tag: (r.by_k, r.by_u) for r in result.collect()}

    def order(r):
        return (r[0], r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or 0.0, r[4])

    by_k, by_u = {}, {}
    assert len(got) == len(rows)
    for t, u, k, v, tag in sorted(rows, key=order):
        for sums, key in ((by_k, k), (by_u, u)):
            sums[key] = sums.get(key, 0.0) + (v or 0.0)
        expected = (by_k[k] if k is not None and v is not None else None, by_u[u] if v is not None else None)
        assert got[tag] == expected


def test_hot_key_and_copies_are_spread(spark):
    df = spark.createDataFrame(skewed_rows(3000), "t int, u int, k string, v double, tag int")
    chunked = order_rows(df, ["t", "u", "k", "v", "tag"], 10)
    sizes = [r["count"] for r in chunked.groupBy(CHUNK).count().collect()]
    assert max(sizes) < 3000 / 3


def test_seq_follows_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    rows = order_rows(df, ["x"], 6).orderBy(SEQ).collect()
    assert [r.x for r in rows] == list(range(1000))
    assert len({r[SEQ] for r in rows}) == 1000


def test_chunked_totals_equal_plain_windows(log, ordered):
    plain = running_totals_by_window(log)
    columns = [*LOG_ORDER, *RUNNING_COLUMNS]
    assert same_rows(running_totals(ordered).select(*columns), plain.select(*columns))


def test_totals_do_not_depend_on_chunks(spark, log):
    columns = [*LOG_ORDER, *RUNNING_COLUMNS]
    few = running_totals(order_log(log, 1)).select(*columns)
    many = running_totals(order_log(log, 50)).select(*columns)
    assert same_rows(few, many)


def test_filter_before_equals_filter_after(ordered):
    early = F.col("order_date") < F.lit("1996-02-01").cast("timestamp_ntz")
    columns = [ROW_TAG, *RUNNING_COLUMNS]
    before = running_totals(ordered.where(early)).select(*columns)
    after = running_totals(ordered).where(early).select(*columns)
    assert same_rows(before, after)


def test_ties_use_rows_not_ranges(spark):
    rows = [(1, "2011-01-01", 1, i, 5, 1, 1.0, 2.0, 1.0, "x") for i in range(4)]
    schema = "customer_id long, d string, order_id long, line_no int, product_id long, supplier_id long, quantity double, total double, price double, country string"
    df = spark.createDataFrame(rows, schema).withColumn("order_date", F.col("d").cast("timestamp_ntz")).drop("d")
    totals = running_totals(order_log(df), ["customer_id"]).orderBy("line_no").collect()
    assert [r.cumsum_total_by_cust_id for r in totals] == [2.0, 4.0, 6.0, 8.0]


def test_no_key_needs_a_shuffle_of_its_own(ordered):
    """All seven windows run inside one exchange by chunk."""
    plan = running_totals(ordered)._jdf.queryExecution().executedPlan().toString()
    above_union = plan[: plan.index("Union")]
    assert above_union.count("Exchange") == 1 and "Join" not in plan


def test_a_large_customer_is_cut_into_blocks(monkeypatch, ordered):
    import spendcast.operators.features as features

    whole = customer_snapshot_features(ordered, ["1996-02", "1999-01"])
    monkeypatch.setattr(features, "ROWS_PER_BLOCK", 3)
    cut = customer_snapshot_features(ordered, ["1996-02", "1999-01"])
    exact = [c for c in whole.columns if not c.endswith(("__std", "__skew"))]
    assert same_rows(whole.select(*exact), cut.select(*exact))
    moments = [c for c in whole.columns if c not in exact]
    joined = whole.alias("a").join(cut.alias("b"), ["customer_id", "year_month"])
    worst = joined.agg(*[F.max(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) / (1 + F.abs(F.col(f"a.{c}")))).alias(c) for c in moments]).first()
    assert max(v for v in worst if v is not None) < 1e-6


def test_amounts_too_large_for_units(spark):
    """Totals beyond 64 bits of units are added in two parts, with the same result for smaller ones."""
    rows = [(1, "2011-01-01", i, i, 5, 1, q, q, q, "x") for i, q in enumerate([3e11, 3e11, -3e11, 0.25, 1e11])]
    schema = "customer_id long, d string, order_id long, line_no int, product_id long, supplier_id long, quantity double, total double, price double, country string"
    df = spark.createDataFrame(rows, schema).withColumn("order_date", F.col("d").cast("timestamp_ntz")).drop("d")
    totals = running_totals(order_log(df), ["customer_id"]).orderBy("line_no").collect()
    assert [r.cumsum_total_by_cust_id for r in totals] == [3e11, 6e11, 3e11, 3e11 + 0.25, 4e11 + 0.25]


def test_only_common_keys_enter_from_earlier_chunks(spark):
    """Rare keys, spread over all chunks, made one row more for nearly every row of theirs."""
    rng = random.Random(11)
    keys = ["hot" if i % 2 else f"rare{rng.randrange(900)}" if i % 50 else None for i in range(6000)]
    rows = [(i, k, rng.choice([None, 1, 5, -3])) for i, k in enumerate(keys)]
    ordered = order_rows(spark.createDataFrame(rows, "t int, k string, v long").repartition(4), ["t"], 6)
    cut, marked = parted(ordered, "k", 6, len(rows))
    assert {r.k for r in cut.select("k").distinct().collect()} == {"hot"}
    # rare keys lie in one part each, common ones and missing keys in as many as there are chunks
    parts = {r.k: r.n for r in marked.groupBy("k").agg(F.countDistinct(PART).alias("n")).collect()}
    assert parts.pop("hot") == parts.pop(None) == 6 and set(parts.values()) == {1}
    assert max(r["count"] for r in marked.groupBy(PART).count().collect()) < 6000 / 3
    got = {r.t: r.s for r in running_sums(ordered, {"k": {"s": "v"}}).collect()}
    so_far = {}
    for t, k, v in rows:
        so_far[k] = so_far.get(k, 0) + (v or 0)
        assert got[t] == (so_far[k] if k is not None and v is not None else None)
