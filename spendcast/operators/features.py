"""The wide per-customer feature table, for any number of snapshot months in one pass."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcast.functions.calendar import derive_time_keys, filter_before_snapshot, moment
from spendcast.functions.scoring import FROM_PARTS_SQL
from spendcast.functions.stats import STATE_SQL, merged_mean_sql, merged_moment_sql, merged_statistic_sql
from spendcast.operators.running_totals import CUSTOMER_ROW, running_totals, running_totals_in_parts
from spendcast.operators.snapshots import SNAPSHOT, snapshot_range_join
from spendcast.schema import DISTINCT_COLUMNS, MEASURES, PLACES, STATISTICS, VALUES, feature_column
from spendcast.session import discard, freed, materialize

KEYS = ("customer_id", SNAPSHOT)
# A customer with more rows than this is summed up in several tasks first.
ROWS_PER_BLOCK = 1_000_000
# Snapshots from which states of intervals are merged in SQL.
STATES_FROM = 6
# States of all measures: count, sum in two parts, extremes, second and third central moment, one list each.
LISTED_STATES = [
    T.StructField(name, T.ArrayType(kind))
    for kind, names in ((T.LongType(), ("n", "whole", "rest")), (T.DoubleType(), ("min", "max", "m2", "m3")))
    for name in names
]
# Parts into which the values of a customer with more rows than a block are dealt.
VALUE_BLOCKS = 64
# A log with more rows than this is summed up for some customers after the others, so that less of it is on disk at a time.
ROWS_PER_PASS = 20_000_000
# Each pass reads the log again, so there are no more passes than this.
MOST_PASSES = 32
PASS = "_pass"
# Rows with their totals are wider than the log: they are made this often at most, each time for some of the passes.
ROUNDS = 3


def brought_together(running: DataFrame) -> DataFrame:
    """Rows with a customer, and ``block``, by which a customer of unusual size is cut.

    Rows are brought together by customer before they are aggregated: partial states of so many statistics are far wider
    than a row, so they must not be shipped one per row. The states of a customer's blocks are then merged.
    """
    block = F.floor((F.col(CUSTOMER_ROW) - 1) / ROWS_PER_BLOCK)
    return running.where(F.col("customer_id").isNotNull()).withColumn("block", block)


def interval_of(df: DataFrame, months: Sequence[str]) -> Column:
    """The place of the first of the ordered ``months`` that a row lies before; the last one for all rows after them."""
    place = F.lit(len(months) - 1)
    for i in range(len(months) - 2, -1, -1):
        place = F.when(F.col("order_date") < moment(df, months[i]), F.lit(i)).otherwise(place)
    return place


def snapshots_between(months: Sequence[str]) -> Column:
    """The months from the place ``interval`` up to ``next``, which is left out."""
    return F.slice(F.array(*[F.lit(m) for m in months]), F.col("interval") + 1, F.col("next") - F.col("interval"))


def interval_states(running: DataFrame, months: Sequence[str], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Mergeable states of every measure per customer and interval between cut-offs: each row is aggregated once.

    ``interval`` is the place, in order, of the first month that a row lies before. A state is the count, the exact sum in
    two parts, the extremes, and the second and third central moments.
    """
    months = sorted(set(months))
    interval = interval_of(running, months)
    together = brought_together(filter_before_snapshot(running, months[-1]))
    together = together.select("customer_id", interval.alias("interval"), "block", *measures).repartition("customer_id", "block")
    states = [f"{sql.format(c=f'`{c}`')} AS `{c}{part}`" for c in measures for part, sql in STATE_SQL.items()]
    return together.groupBy("customer_id", "interval").agg(*[F.expr(x) for x in states])


def snapshot_statistics(
    running: DataFrame,
    months: Sequence[str],
    measures: Sequence[str] = MEASURES,
    statistics: Sequence[str] = STATISTICS,
    separator: str = "__",
) -> DataFrame:
    """Statistics of every measure per customer and snapshot, in the way that suits the number of snapshots."""
    way = statistics_by_states if len(set(months)) >= STATES_FROM else statistics_by_rows
    return way(running, months, measures, statistics, separator)


def fragment_states(rows: DataFrame, measures: Sequence[str]) -> DataFrame:
    """``customer_id, interval`` and states of all measures, a list each, of what lies together in a batch of ``rows``.

    A state is the count, the exact sum in two parts, the extremes, and the second and third central moments.
    """
    schema = T.StructType([rows.schema["customer_id"], rows.schema["interval"], *LISTED_STATES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.cast(pa.float64()) for c in batch.columns[2:]]
            there = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
            x = np.array([c.fill_null(0.0).to_numpy() for c in columns])
            if not np.isfinite(x).all():
                raise ValueError("an amount is not a finite number")
            first = borders(batch.columns[:2])
            sizes = np.diff(np.append(first, batch.num_rows))
            together = lambda values, how=np.add: how.reduceat(values, first, axis=1)
            n = together(there.astype(np.int64))
            floor = np.floor(x)
            units = (x - floor) * 10.0**PLACES
            rest = np.floor(units)
            rest += units - rest >= 0.5
            whole, rest = together(floor.astype(np.int64)), together(rest.astype(np.int64))
            low = together(np.where(there, x, np.inf), np.minimum)
            high = together(np.where(there, x, -np.inf), np.maximum)
            away = (x - np.repeat(mean_of(n, whole, rest), sizes, axis=1)) * there
            m2, m3 = together(away * away), together(away * away * away)
            states = [listed(s.T) for s in (n, whole, rest, low, high, m2, m3)]
            keys = [c.take(pa.array(first)) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([*keys, *states], names=schema.names)

    return rows.select("customer_id", "interval", *measures).mapInArrow(run, schema)


def states_up_to(fragments: DataFrame, months: Sequence[str]) -> DataFrame:
    """``customer_id, year_month`` and the states of all rows before each of the ordered ``months``.

    Moments are taken anew about the mean of all rows, so nothing cancels. A customer's fragments are few: one for each
    interval, and one for each batch or block that cuts it.
    """
    schema = T.StructType([fragments.schema["customer_id"], T.StructField(SNAPSHOT, T.StringType()), *LISTED_STATES])
    met = fragments.repartition("customer_id").sortWithinPartitions("customer_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            interval = batch.column(1).to_numpy()
            for i, month in enumerate(months):
                rows = pa.array(interval <= i)
                some = batch.filter(rows)
                if not some.num_rows:
                    continue
                first = borders(some.columns[:1])
                sizes = np.diff(np.append(first, some.num_rows))
                n, whole, rest, low, high, m2, m3 = (c.flatten().to_numpy().reshape(some.num_rows, -1) for c in some.columns[2:])
                together = lambda values, how=np.add: how.reduceat(values, first, axis=0)  # noqa: E731, B023
                all_n, all_whole, all_rest = together(n), together(whole), together(rest)
                away = mean_of(n, whole, rest) - np.repeat(mean_of(all_n, all_whole, all_rest), sizes, axis=0)
                away *= n > 0
                all_m2 = together(m2 + n * away * away)
                all_m3 = together(m3 + away * (3 * m2 + n * away * away))
                states = (all_n, all_whole, all_rest, together(low, np.minimum), together(high, np.maximum), all_m2, all_m3)
                keys = [some.column(0).take(pa.array(first)), pa.array([month] * len(first))]
                yield pa.RecordBatch.from_arrays([*keys, *[listed(s) for s in states]], names=schema.names)

    return met.mapInArrow(run, schema)


def borders(columns: Sequence[pa.Array]) -> np.ndarray:
    """The first row of each group of rows in a row that are equal in all columns, which have no NULL."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that rows equal in the first column, by which they are sorted, come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = borders(batch.columns[:1])
        if held and batch.column(0)[0] != held[0].column(0)[0]:
            yield pa.concat_batches(held)
            held = []
        if len(first) > 1:
            yield pa.concat_batches([*held, batch.slice(0, first[-1])])
            held = []
        held.append(batch.slice(first[-1]))
    if held:
        yield pa.concat_batches(held)


def mean_of(n: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (whole + rest / 10.0**PLACES) / np.maximum(n, 1)


def listed(states: np.ndarray) -> pa.Array:
    """One list per row."""
    offsets = np.arange(len(states) + 1, dtype=np.int32) * np.int32(states.shape[1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(states).reshape(-1)))


def statistics_by_rows(
    running: DataFrame,
    months: Sequence[str],
    measures: Sequence[str] = MEASURES,
    statistics: Sequence[str] = STATISTICS,
    separator: str = "__",
) -> DataFrame:
    """Statistics from the rows themselves, which meet by customer; no row is repeated for a snapshot.

    Rows of a batch are summed up at once, for all measures, and what belongs to one customer is merged.
    """
    months = sorted(set(months))
    together = brought_together(filter_before_snapshot(running, months[-1]))
    together = together.select("customer_id", interval_of(running, months).alias("interval"), "block", *measures)
    together = together.repartition("customer_id", "block").sortWithinPartitions("customer_id", "interval")
    states = states_up_to(fragment_states(together, measures), months)
    parts = [f"`{s.name}`[{i}] AS `{c}_{s.name}_to`" for i, c in enumerate(measures) for s in LISTED_STATES]
    states = states.selectExpr(*KEYS, *parts)
    # without a value there is no least one
    sums = {c: F.expr(f"CASE WHEN `{c}_n_to` > 0 THEN {FROM_PARTS_SQL.format(w=f'`{c}_whole_to`', r=f'`{c}_rest_to`')} END") for c in measures}
    states = states.withColumns({f"{c}_sum_to": x for c, x in sums.items()})
    own = {
        "mean": "try_divide(`{c}_sum_to`, `{c}_n_to`)",
        "sum": "coalesce(`{c}_sum_to`, 0D)",
        "min": "CASE WHEN `{c}_n_to` > 0 THEN `{c}_min_to` END",
        "max": "CASE WHEN `{c}_n_to` > 0 THEN `{c}_max_to` END",
    }
    wanted = [
        f"{own[s].format(c=c) if s in own else merged_statistic_sql(c, s)} AS `{feature_column(c, s, separator)}`"
        for c in measures
        for s in statistics
    ]
    return states.selectExpr(*KEYS, *wanted)


def statistics_by_states(
    running: DataFrame,
    months: Sequence[str],
    measures: Sequence[str] = MEASURES,
    statistics: Sequence[str] = STATISTICS,
    separator: str = "__",
) -> DataFrame:
    """Statistics of every measure per customer and snapshot, from states of the intervals up to the snapshot.

    Counts, sums and extremes of a snapshot are running ones over its intervals. Moments are taken anew about the mean of
    all rows so far, interval by interval, so nothing cancels. All this happens per customer and interval, so another
    snapshot adds rows of that size and not another pass over the log.
    """
    months = sorted(set(months))
    in_order = Window.partitionBy("customer_id").orderBy("interval")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = {}
    for c in measures:
        for part, how in (("_n", F.sum), ("_whole", F.sum), ("_rest", F.sum), ("_min", F.min), ("_max", F.max)):
            merged[f"{c}{part}_to"] = how(f"`{c}{part}`").over(so_far)
    states = interval_states(running, months, measures)
    own_mean = FROM_PARTS_SQL.format(w="`{c}_whole`", r="`{c}_rest`") + " / `{c}_n`"
    states = states.withColumns({f"{c}_mean": F.expr(f"CASE WHEN `{c}_n` > 0 THEN {own_mean.format(c=c)} END") for c in measures})
    moments = [F.col(f"`{c}{part}`") for c in measures for part in ("_n", "_mean", "_m2", "_m3")]
    merged["past"] = F.collect_list(F.struct(*moments)).over(so_far)  # as many as there are intervals
    # a snapshot between two intervals of a customer has the rows of the first one
    merged["next"] = F.coalesce(F.lead("interval").over(in_order), F.lit(len(months)))
    to_here = states.select("customer_id", "interval", *[x.alias(name) for name, x in merged.items()])
    to_here = to_here.withColumns({f"{c}_mean_to": F.expr(merged_mean_sql(c)) for c in measures})
    to_here = to_here.withColumns({f"{c}_m{i}_to": F.expr(merged_moment_sql(c, i)) for c in measures for i in (2, 3)})
    wanted = [f"{merged_statistic_sql(c, s)} AS `{feature_column(c, s, separator)}`" for c in measures for s in statistics]
    each = to_here.selectExpr("customer_id", "interval", "next", *wanted)
    return each.withColumn(SNAPSHOT, F.explode(snapshots_between(months))).drop("interval", "next").select(*KEYS, *[feature_column(c, s, separator) for c in measures for s in statistics])


def snapshot_distinct_counts(
    log: DataFrame, months: Sequence[str], columns: Sequence[str] = DISTINCT_COLUMNS, separator: str = "__"
) -> DataFrame:
    """Exact distinct counts per customer and snapshot.

    A value counts for a snapshot when its first order lies before it. One aggregate finds the first
    order of each customer and value, and only those pairs are repeated per snapshot.
    """
    log = derive_time_keys(filter_before_snapshot(log, max(months))).where(F.col("customer_id").isNotNull())
    first_seen = log.groupingSets(
        [["customer_id", c] for c in columns], "customer_id", *columns
    ).agg(F.min("order_date").alias("order_date"))
    # in each grouping set the other columns are NULL, so a plain count sees one set only
    counts = [F.count(c).alias(feature_column(c, "nunique", separator)) for c in columns]
    return snapshot_range_join(first_seen, months).groupBy(*KEYS).agg(*counts)


def snapshot_approx_distinct_counts(
    log: DataFrame,
    months: Sequence[str],
    columns: Sequence[str] = DISTINCT_COLUMNS,
    error: float = 0.02,
    separator: str = "__",
) -> DataFrame:
    """Distinct counts per customer and snapshot with a relative standard error of at most ``error``.

    Each row enters one sketch per column, that of its customer and interval between two cut-offs. A snapshot's sketch is
    the union of those up to it, so neither rows nor values are repeated per snapshot. Small counts come out exact.
    """
    if not 0 < error < 1:
        raise ValueError(f"a relative error lies between 0 and 1, not at {error}")
    registers = F.lit(min(21, max(4, math.ceil(2 * math.log2(1.04 / error)))))
    months = sorted(set(months))
    log = derive_time_keys(filter_before_snapshot(log, months[-1])).where(F.col("customer_id").isNotNull())
    hashable = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)
    values = [F.col(c) if isinstance(log.schema[c].dataType, hashable) else F.col(c).cast("string").alias(c) for c in columns]
    placed = log.select("customer_id", interval_of(log, months).alias("interval"), *values)
    sketched = placed.groupBy("customer_id", "interval").agg(*[F.hll_sketch_agg(c, registers).alias(c) for c in columns])
    in_order = Window.partitionBy("customer_id").orderBy("interval")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    unions = [F.hll_union_agg(c).over(so_far).alias(c) for c in columns]
    following = F.coalesce(F.lead("interval").over(in_order), F.lit(len(months))).alias("next")
    merged = sketched.select("customer_id", "interval", following, *unions)
    counts = [F.hll_sketch_estimate(c).alias(feature_column(c, "nunique", separator)) for c in columns]
    each = merged.select("customer_id", "interval", "next", *counts)
    return each.withColumn(SNAPSHOT, F.explode(snapshots_between(months))).select(
        *KEYS, *[feature_column(c, "nunique", separator) for c in columns]
    )


def snapshot_modes(log: DataFrame, months: Sequence[str], columns: Sequence[str], separator: str = "__") -> DataFrame:
    """The most frequent value of each column per customer and snapshot, the lowest on a tie; missing values don't count.

    Rows are counted once per customer, value and interval between two cut-offs. Counts only grow, so the mode at a snapshot
    is the largest running count that any value has reached by then: the best of an interval is carried on to the intervals
    after it, and what is repeated per snapshot is one row per customer and never a value. All of a customer meets in one
    task, but for customers with more rows than a block has: their values are dealt by hash, and the best of each part are
    compared. A customer and snapshot without a value in any of the columns has no row.
    """
    months = sorted(set(months))
    log = derive_time_keys(filter_before_snapshot(log, months[-1])).where(F.col("customer_id").isNotNull())
    placed = materialize(log.select("customer_id", interval_of(log, months).alias("interval"), *columns), "values")
    large = placed.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROWS_PER_BLOCK)
    # written, so that its size is known: at most one customer in a million rows
    large = materialize(large.select(F.col("customer_id").alias("_large")), "large")

    def only(c: str) -> list[Column]:
        return [F.col(x) if x == c else F.lit(None).cast(placed.schema[x].dataType).alias(x) for x in columns]

    together = F.array(F.struct(F.lit(0).alias("block"), *columns))
    dealt = F.array(*[F.struct((F.pmod(F.xxhash64(c), F.lit(VALUE_BLOCKS)) + 1).cast("int").alias("block"), *only(c)) for c in columns])
    met = (
        placed.join(large, F.col("customer_id") == F.col("_large"), "left")
        .select("customer_id", "interval", F.inline(F.when(F.col("_large").isNull(), together).otherwise(dealt)))
        .repartition("customer_id", "block")
    )
    # each row names one value of one column, the other columns are NULL
    each = met.select("customer_id", "block", "interval", F.inline(F.array(*[F.struct(*only(c)) for c in columns])))
    each = each.where(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())
    counted = each.groupBy("customer_id", "block", "interval", *columns).agg(F.count(F.lit(1)).alias("n"))
    of_value = Window.partitionBy("customer_id", "block", *columns).orderBy("interval")
    up_to = F.sum("n").over(of_value.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = counted.select("customer_id", "block", "interval", up_to.alias("n"), *columns)
    best = [F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col("n")).alias("fewer"), F.col(c).alias("value")))).alias(c) for c in columns]
    in_block = running.groupBy("customer_id", "block", "interval").agg(*best)
    in_interval = in_block.repartition("customer_id").groupBy("customer_id", "interval").agg(*[F.min(c).alias(c) for c in columns])
    in_order = Window.partitionBy("customer_id").orderBy("interval")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.coalesce(F.lead("interval").over(in_order), F.lit(len(months))).alias("next")
    modes = in_interval.select("customer_id", "interval", following, *[F.min(c).over(so_far).alias(c) for c in columns])
    return modes.withColumn(SNAPSHOT, F.explode(snapshots_between(months))).select(
        *KEYS, *[F.col(c)["value"].alias(feature_column(c, "mode", separator)) for c in columns]
    )


def customer_snapshot_features(
    ordered: DataFrame,
    months: Sequence[str],
    separator: str = "__",
    modes: Sequence[str] = (),
    distinct_error: float | None = None,
    finish: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame] = lambda features, of_pass: features,
    store: str | None = None,
) -> DataFrame:
    """174 features per customer and snapshot month, from the rows strictly before the month.

    ``modes`` adds the most frequent value of each column it names, ``distinct_error`` takes distinct counts from sketches.
    Running totals only look back in the order, which starts with the date, so rows at or after the last
    snapshot are dropped before any of them is computed.

    A large log is worked off in passes by customer. Rows with their totals are written for some of the passes, range by
    range of the order; then each pass takes its customers, writes their features, and drops their rows. ``finish`` makes
    the result of a pass of its features and of a function that leaves a table the customers of the pass. ``store`` names a
    column by whose values the result is stored, also where one pass does.
    """
    spark = ordered.sparkSession
    log = filter_before_snapshot(ordered, max(months))
    kept = ["customer_id", "order_date", *VALUES]

    def features(totals: DataFrame, log: DataFrame) -> DataFrame:
        statistics = snapshot_statistics(totals, months, separator=separator)
        if distinct_error is None:
            distinct = snapshot_distinct_counts(log, months, separator=separator)
        else:
            distinct = snapshot_approx_distinct_counts(log, months, error=distinct_error, separator=separator)
        joined = statistics.join(distinct, list(KEYS))
        return joined.join(snapshot_modes(log, months, modes, separator), list(KEYS), "left") if modes else joined

    passes = min(MOST_PASSES, -(-log.count() // ROWS_PER_PASS))
    if passes <= 1:
        whole = finish(features(running_totals(log, number_customers=True, keep=kept), log), lambda df: df)
        return materialize(whole, "matrix", partition_by=store) if store else whole

    def of_pass(i: int) -> Callable[[DataFrame], DataFrame]:
        return lambda df: df.where(pass_of_customer(passes) == i)

    at_once, done = -(-passes // ROUNDS), []
    with freed(spark) as scratch:
        ranges = running_totals_in_parts(log, number_customers=True, keep=kept, ranges=passes)
        for first in range(0, passes, at_once):
            now = range(first, min(first + at_once, passes))
            known = F.col("customer_id").isNotNull() & F.col(PASS).between(now[0], now[-1])
            rows = [r.withColumn(PASS, pass_of_customer(passes)).where(known) for r in ranges]
            dealt = [materialize(r, "totals", partition_by=PASS, compression="zstd") for r in rows]
            for i in now:
                totals = reduce(DataFrame.unionByName, [d.where(F.col(PASS) == i).drop(PASS) for d in dealt])
                made = finish(features(totals, of_pass(i)(log)), of_pass(i))
                done.append(scratch.keep(materialize(made, "matrix", partition_by=store, compression="zstd")))
                for d in dealt:
                    discard(d, f"{PASS}={i}")
    return reduce(DataFrame.unionByName, done)


def pass_of_customer(passes: int) -> Column:
    return F.pmod(F.xxhash64("customer_id"), F.lit(passes)).cast("int")
