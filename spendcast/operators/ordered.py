"""Running sums that no key can skew.

A window over a key puts the whole key in one task. Here the rows are first range-partitioned by the
wanted order into chunks of like size, whatever their keys. Each chunk is then summed on its own, and
what earlier chunks hold of a key enters the chunk as one extra row in front. The extra rows travel in
the same shuffle as the rows themselves, so nothing is joined and nothing is broadcast, and the largest
unit of work is one chunk. With several keys a chunk is sorted once, by the order, and summed batch by batch for all keys.

With one key only its common values are cut at chunks. All rows of any other value go to one task in the same shuffle,
among many others: nothing enters from earlier chunks, where it would be one row more for nearly every row.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcast.session import materialize

CHUNK = "chunk"
SEQ = "seq"
PART = "_part"
# One row of so many tells which keys are common, and a common key has more than this share of a chunk's rows.
LOOKED_AT = 16
COMMON = 1 / 8


def order_rows(df: DataFrame, order: Sequence, chunks: int | None = None) -> DataFrame:
    """Add ``seq``, unique and rising in ``order``, and ``chunk``, the range of the order it lies in.

    Range bounds come from a sample and may differ from run to run, so the result is written once and
    read back: every later use sees the same chunks. ``chunks`` defaults to the shuffle partitions of
    the session; choose it so that one chunk's rows fit the memory of a task.
    """
    return ordered_parts(df, order, chunks)[0]


def ordered_parts(df: DataFrame, order: Sequence, chunks: int | None = None, ranges: int = 1, compression: str | None = None) -> list[DataFrame]:
    """The rows of :func:`order_rows` as so many tables at most, written one after the other, so that one range of the order
    is shuffled at a time. Where there are several, their bounds are values of the first column; ``df`` is read for each."""
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = [F.lit(True)] if ranges <= 1 else between_bounds(df, order[0], ranges)
    n = -(-n // len(whole))
    parts = []
    for i, here in enumerate(whole):
        numbered = (
            (df if len(whole) == 1 else df.where(here))
            .repartitionByRange(n, *order)
            .sortWithinPartitions(*order)
            .withColumn(SEQ, F.monotonically_increasing_id() + F.lit(i * n << 33))
        )
        # monotonically_increasing_id holds the partition number above its lower 33 bits
        parts.append(materialize(numbered.withColumn(CHUNK, F.shiftright(SEQ, 33).cast("int")), "ordered", compression=compression))
    return parts


def between_bounds(df: DataFrame, column: str, ranges: int) -> list[Column]:
    """Conditions that cut ``df`` into so many ranges of a column at most, of like size, in rising order, NULL first."""
    found = df.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)]).alias("at")).select(F.col("at").cast("array<string>")).first()[0]
    kind = df.schema[column].dataType
    bounds = [F.lit(b).cast(kind) for b in dict.fromkeys(found or [])]
    value = F.col(column)
    under = [value.isNull() | (value < b) for b in bounds] + [F.lit(True)]
    over = [F.lit(True)] + [value >= b for b in bounds]
    return [a & b for a, b in zip(over, under, strict=True)]


def running_sums(
    ordered: DataFrame, sums: Mapping[str, Mapping[str, str]], keep: Sequence[str] | None = None
) -> DataFrame:
    """Inclusive running sums in ``seq`` order, beside the columns ``keep`` (all, if none are named).

    ``sums`` maps a key column to ``{output column: value column}``. Where the key or the value is NULL
    the output is NULL, and a NULL value adds nothing to the rows after it. Integers add up exactly,
    whatever the chunks.
    """
    return running_sums_in_parts(ordered, sums, keep)[0]


def running_sums_in_parts(
    ordered: DataFrame, sums: Mapping[str, Mapping[str, str]], keep: Sequence[str] | None = None, parts: int = 1
) -> list[DataFrame]:
    """The rows of :func:`running_sums` as so many tables at most, one for each range of chunks, not computed yet.

    Where there are several, what enters a chunk is written first, and a caller that writes one after the other has the
    shuffled rows of one range on disk at a time. One key is summed in one part.
    """
    keys, kept = list(sums), list(ordered.columns if keep is None else keep)
    values = list(dict.fromkeys(v for outputs in sums.values() for v in outputs.values()))

    # chunk i goes to partition i, whatever the shuffle partitions: a task never holds two chunks
    partitions, size = ordered.agg(F.max(CHUNK), F.count(F.lit(1))).first()
    partitions = 1 if partitions is None else partitions + 1
    in_batches = len(keys) > 1 and all(isinstance(ordered.schema[v].dataType, T.LongType) for v in values)
    ordered = ordered.select(*dict.fromkeys([*kept, CHUNK, SEQ, *keys, *values]))
    if len(keys) == 1:
        cut, ordered = parted(ordered, keys[0], partitions, size)
    else:
        cut, ordered = ordered, ordered.select(*[c for c in ordered.columns if c != CHUNK or c in kept], F.col(CHUNK).alias(PART))

    per_chunk = (
        cut.groupingSets([[CHUNK, k] for k in keys], CHUNK, *keys)
        .agg(*[F.sum(v).alias(v) for v in values])
        .where(_any_not_null(keys))
    )
    # one row per key and chunk here, so even a key found in every chunk is a short group
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        per_chunk.select(F.col(CHUNK).alias(PART), *keys, *[F.sum(v).over(earlier).alias(v) for v in values])
        .where(_any_not_null(values))
        .withColumn(SEQ, F.lit(-1).cast("bigint"))
    )

    if in_batches and parts > 1:
        carried = materialize(carried, "carried", compression="zstd")
        width, found = -(-partitions // parts), []
        for low in range(0, partitions, width):
            high = min(low + width, partitions)
            here = F.col(PART).between(low, high - 1)
            rows = ordered.where(here).unionByName(carried.where(here), allowMissingColumns=True)
            found.append(summed_in_batches(rows.repartitionById(high - low, F.col(PART) - low), sums, values, kept))
        return found
    rows = ordered.unionByName(carried, allowMissingColumns=True).repartitionById(partitions, PART)
    if in_batches:
        return [summed_in_batches(rows, sums, values, kept)]
    outputs = {}
    for key, named in sums.items():
        so_far = (
            Window.partitionBy(key, PART).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        for name, value in named.items():
            outputs[name] = F.when(
                F.col(key).isNotNull() & F.col(value).isNotNull(), F.sum(value).over(so_far)
            )
    summed = rows.select(*ordered.columns, *[c.alias(n) for n, c in outputs.items()]).where(F.col(SEQ) >= 0)
    return [summed.select(*kept, *outputs)]


def parted(ordered: DataFrame, key: str, partitions: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The rows of common keys, and all rows with ``PART``: the chunk of a common key or none, else a number made of the key.

    Which keys are common is looked up in a part of the rows. It says where rows are summed, never what they sum to, and
    a key that is missed has hardly more rows than a common one has at least.
    """
    looked_at = ordered.where(F.pmod(F.xxhash64(SEQ), F.lit(LOOKED_AT)) == 0).where(F.col(key).isNotNull())
    counts = looked_at.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    # so many rows have at most partitions / COMMON keys
    common = counts.where(F.col("_n") * LOOKED_AT > COMMON * size / partitions).select(F.col(key).alias("_common"))
    common = F.broadcast(materialize(common, "common-keys"))
    same = F.col(key) == F.col("_common")
    by_key = F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")
    marked = ordered.join(common, same, "left")
    part = F.when(F.col("_common").isNotNull() | F.col(key).isNull(), F.col(CHUNK)).otherwise(by_key)
    return ordered.join(common, same, "left_semi"), marked.withColumn(PART, part).drop("_common")


class Places(dict):
    """A number for every value, in the order in which they come."""

    def __missing__(self, value) -> int:
        self[value] = place = len(self)
        return place


def summed_in_batches(
    rows: DataFrame, sums: Mapping[str, Mapping[str, str]], values: Sequence[str], kept: Sequence[str]
) -> DataFrame:
    """``kept`` and the sums of all keys, from one pass over a chunk in its order.

    A task holds the sums so far of the keys of its chunk, and one batch of rows. Rows that bring in what earlier chunks
    hold lie in front and are left out.
    """
    rows = rows.sortWithinPartitions(SEQ)
    names = [n for outputs in sums.values() for n in outputs]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {k: Places() for k in sums}
        so_far = {k: np.zeros((0, len(outputs)), np.int64) for k, outputs in sums.items()}
        for batch in batches:
            of = dict(zip(batch.schema.names, batch.columns, strict=True))
            there = {v: of[v].is_valid().to_numpy(zero_copy_only=False) for v in values}
            added = {v: of[v].fill_null(0).to_numpy() for v in values}
            made = []
            for key, outputs in sums.items():
                coded = of[key].dictionary_encode()
                codes = coded.indices.fill_null(-1).to_numpy()
                place = np.fromiter(map(places[key].__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
                if len(places[key]) > len(so_far[key]):
                    # room for as many again, so that growing costs no more than the rows do
                    so_far[key] = np.pad(so_far[key], ((0, 2 * len(places[key]) - len(so_far[key])), (0, 0)))
                total = so_far[key]
                order = np.argsort(codes, kind="stable")
                order = order[np.searchsorted(codes[order], 0) :]
                first = np.flatnonzero(np.diff(codes[order], prepend=-1))
                sizes = np.diff(np.append(first, len(order)))
                for i, value in enumerate(outputs.values()):
                    sums_to = np.cumsum(added[value][order])
                    before = np.append(0, sums_to)[first]
                    sums_to += np.repeat(total[place, i] - before, sizes)
                    total[place, i] = sums_to[first + sizes - 1]
                    out = np.zeros(len(codes), np.int64)
                    out[order] = sums_to
                    made.append(pa.array(out, mask=~(there[value] & (codes >= 0))))
            result = pa.RecordBatch.from_arrays([*[of[c] for c in kept], *made], names=schema.names)
            own = of[SEQ].to_numpy() >= 0
            yield result if own.all() else result.filter(pa.array(own))

    return rows.mapInArrow(run, schema)


def _any_not_null(columns):
    return F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in columns], F.lit(False))
