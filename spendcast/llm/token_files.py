"""Token files: ids ranked by frequency in a byte-aligned variable-length code.

A frequent id has a small rank and takes one byte, others two to four. The lengths of four codes make one control
byte; control bytes are stored apart from data bytes, so a reader looks up the lengths of all codes in a table and
gathers their bytes without a loop over codes.

The container is a folder with two Parquet tables that Spark commits as a whole: ``blocks`` (documents in ascending
key order, ``part`` and ``seq`` give the order of blocks) and ``ranks`` (the id of every rank).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendcast.llm.text import ROW_TAG, python_workers, tagged
from spendcast.llm.tokens import token_ids
from spendcast.session import materialize, scratch_path

TOKENS_PER_BLOCK = 1 << 18
# Lengths of the four codes of every control byte, made from the rule: two bits each, lowest first.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def pack_codes(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    data = np.empty(int(lengths.sum()), np.uint8)
    data[starts] = values.astype(np.uint8)
    for i in range(1, int(lengths.max(initial=1))):
        longer = np.flatnonzero(lengths > i)
        data[starts[longer] + i] = (values[longer] >> np.uint32(8 * i)).astype(np.uint8)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def unpack_codes(control: bytes, data: bytes, count: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    starts = np.cumsum(lengths) - lengths
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    values = raw[starts].astype("<u4")
    for i in range(1, int(lengths.max(initial=1))):
        longer = np.flatnonzero(lengths > i)
        values[longer] |= raw[starts[longer] + i].astype("<u4") << np.uint32(8 * i)
    return values


def id_counts(tokens: DataFrame) -> DataFrame:
    """``id`` and ``n``, how often it occurs in all rows; one row per id and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            widths = batch.column(1).to_numpy()
            for width in np.unique(widths):
                rows = batch.column(0).filter(pa.array(widths == width)).to_pylist()
                found = np.bincount(np.frombuffer(b"".join(rows), f"<u{width}"), minlength=len(total))
                total = np.pad(total, (0, len(found) - len(total))) + found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return tokens.select("ids", "width").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2
) -> None:
    """Encode every whole text and write the folder ``path``.

    A NULL or empty text has the end id alone. Rows of one key stay apart, in any order. An empty table gives empty
    tables. Only the counts of the vocabulary's ids pass through the driver.
    """
    spark = docs.sparkSession
    scratch = scratch_path(spark, "token-ids")
    encoded = token_ids(docs, key, text, tokenizer, end_id)
    encoded.write.parquet(scratch)
    tokens = spark.read.schema(encoded.schema).parquet(scratch)

    ranked = id_counts(tokens).orderBy(F.col("n").desc(), "id")
    by_rank = np.array([row.id for row in ranked.collect()], np.int64)  # at most the vocabulary
    rank_of = np.zeros(by_rank.max() + 1 if len(by_rank) else 0, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(by_rank)), "id": by_rank}), "rank long, id long").coalesce(
        1
    ).write.parquet(f"{path}/ranks")
    schema = T.StructType.fromDDL("part int, seq int, lengths array<int>, control binary, data binary")
    schema = schema.add("keys", T.ArrayType(docs.select(F.col(f"`{key}`")).schema[0].dataType))
    arrow = to_arrow_schema(schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, keys, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block() -> pa.RecordBatch:
            control, data = pack_codes(np.concatenate(ids))
            values = (part, seq, [len(x) for x in ids], control, data, keys)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for name, raw, width in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                keys.append(name)
                ids.append(rank_of[np.frombuffer(raw, f"<u{width}")])
                size += len(ids[-1])
                if size >= TOKENS_PER_BLOCK:
                    yield block()
                    seq, keys, ids, size = seq + 1, [], [], 0
        if ids:
            yield block()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = tagged(tokens).repartitionByRange(n, F.col(f"`{key}`"), ROW_TAG).sortWithinPartitions(F.col(f"`{key}`"), ROW_TAG)
    written = ordered.select(F.col(f"`{key}`").alias("key"), "ids", "width").mapInArrow(blocks, schema)
    written.write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``.

    ``ids`` are little-endian unsigned 32-bit numbers. Starts are running sums within a part, after the parts before.
    """
    python_workers(spark)
    by_rank = np.array([row.id for row in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    files = spark.read.parquet(f"{path}/blocks")
    schema = T.StructType.fromDDL("start long, n_tokens long, ids binary")
    schema = schema.add("key", files.schema["keys"].dataType.elementType)
    arrow = to_arrow_schema(schema)
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
    sizes = files.select(F.col("part").alias("_p"), F.col("seq").alias("_s"), size.alias("size"))
    totals = sizes.groupBy("_p").agg(F.sum("size").alias("total"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts = totals.select(F.col("_p").alias("_part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    in_part = Window.partitionBy("_p").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", "_s", F.coalesce(F.sum("size").over(in_part), F.lit(0)).alias("in_part"))
    starts = starts.join(parts, F.col("_p") == F.col("_part")).select("_p", "_s", (F.col("before") + F.col("in_part")).alias("from"))
    # written, so that its size is known: blocks find their starts before they are decoded, and ids are not moved
    starts = materialize(starts, "block-starts")
    placed = files.join(starts, (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                start, control, data = (of[name][i].as_py() for name in ("from", "control", "data"))
                lengths = np.array(of["lengths"][i].values, np.int64)
                ids = by_rank[unpack_codes(control, data, int(lengths.sum()))].astype("<u4")
                ends = np.cumsum(lengths)
                # the documents of a block share one buffer; keys never leave Arrow
                cuts = pa.array(np.append(0, 4 * ends).astype(np.int32))
                each = pa.Array.from_buffers(pa.binary(), len(lengths), [None, cuts.buffers()[1], pa.py_buffer(ids.tobytes())])
                columns = (start + ends - lengths, lengths, each, of["keys"][i].values)
                columns = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    rows = placed.select("from", "lengths", "control", "data", "keys").mapInArrow(decode, schema)
    return rows.select(F.col("key").alias(key), "start", "n_tokens", "ids")
