"""What all text operators mean by a word, and small column helpers."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable, Collection, Hashable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendcast.session import materialize

# The white space of the word pattern [^\x20\x09-\x0D]+.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]"
# Bits of a field that tells tasks which values or texts matter: 4 MB, whatever their number.
FIELD_BITS = 25
# Row numbers hold their task's number above 33 bits; this one spreads tasks over the field and the product fits 64 bits.
SPREAD = 2_654_435_761
# Private columns start with an underscore, so that a table's own columns don't clash with them.
ROW_TAG = "_row_tag"


def whole(text: str) -> Column:
    """The text, or an empty one for NULL."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, f"[{WHITE}]+"), "")


def n_words(text: str) -> Column:
    return F.size(words(whole(text))).cast("long")


def tagged(df: DataFrame) -> DataFrame:
    """Number the rows, so that equal rows stay apart."""
    return df.withColumn(ROW_TAG, F.monotonically_increasing_id())


def steadily_tagged(df: DataFrame) -> DataFrame:
    """Rows with numbers that are the same at every reading.

    The numbered rows are written once: a scan is cut into tasks by the cores registered at the time, so numbers given
    while reading differ between jobs when executors come and go.
    """
    return materialize(tagged(df), "numbered")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that would clash with an operator's own, whatever their case."""
    own = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in own])


class WordHashes(dict):
    """64-bit hashes of words in UTF-8, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(words: Collection[bytes]) -> np.ndarray:
    """The same hashes without a memory: hashing a word takes less time than finding it among hundreds of thousands."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


# Texts are long, so few of them make a batch for Python.
ROWS_PER_BATCH = 1_000


def python_workers(spark: SparkSession) -> None:
    """Small Arrow batches, and this package on the path of Python workers that share the driver's folders."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    home, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, home])


# What this Python worker keeps from one task to the next, such as a cache of tokens.
_kept: dict = {}
# When it was last asked for, and the thread that drops it later.
_asked = 0.0
_watch: threading.Thread | None = None
_lock = threading.RLock()
# Seconds after which it is dropped if nobody asks for it: an idle worker's memory is its executor's.
IDLE_SECONDS = 5.0


def kept(name: Hashable, make: Callable):
    """What ``make`` returns, made once in a Python worker, until ``let_go`` or until nobody has asked for a while."""
    global _asked, _watch
    with _lock:
        if name not in _kept:
            _kept[name] = make()
        _asked = time.monotonic()
        if _watch is None:
            _watch = threading.Thread(target=_drop_when_idle, daemon=True)
            _watch.start()
        return _kept[name]


def _drop_when_idle() -> None:
    global _watch
    while True:
        with _lock:
            left = _asked + IDLE_SECONDS - time.monotonic()
            if left <= 0:
                let_go()
                _watch = None
                return
        time.sleep(left)


def let_go() -> None:
    """Spark gives idle workers other work, and what they keep would lie beside it in the executor's memory."""
    if _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()


def map_texts(docs: DataFrame, carried: Sequence[str], text: str, work: Callable, made: str) -> DataFrame:
    """``carried`` columns as they are, beside the columns ``made`` (as DDL) that ``work`` makes of whole texts.

    ``work`` gets the texts of a batch as UTF-8 bytes (NULL is an empty one) and returns the places of the texts its rows
    come from, or None for one row per text, and a list or array per made column. Carried columns never leave Arrow, so a
    number beside a NULL keeps all its digits, and their names may be any.
    """
    return map_columns(docs, carried, [F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b""))], work, made)


def map_columns(docs: DataFrame, carried: Sequence[str], inputs: Sequence[Column], work: Callable, made: str) -> DataFrame:
    """The same for any ``inputs``: ``work`` gets one list of Python values per input."""
    python_workers(docs.sparkSession)
    new = T.StructType.fromDDL(made)
    kinds = [T.StructField(f"_{i}", docs.select(F.col(f"`{c}`")).schema[0].dataType) for i, c in enumerate(carried)]
    kinds += [T.StructField(f"_{len(carried) + i}", f.dataType) for i, f in enumerate(new)]
    kinds = T.StructType(kinds)
    arrow, n = to_arrow_schema(kinds), len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, columns = work(*[batch.column(i).to_pylist() for i in range(n, batch.num_columns)])
            kept = [batch.column(i) for i in range(n)]
            if places is not None:
                at = pa.array(places, pa.int64())
                kept = [c.take(at) for c in kept]
            fresh = [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[n:], strict=True)]
            yield pa.RecordBatch.from_arrays(kept + fresh, schema=arrow)

    asked = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carried)]
    asked += [c.alias(f"_{n + i}") for i, c in enumerate(inputs)]
    return docs.select(*asked).mapInArrow(run, kinds).toDF(*carried, *[f.name for f in new])


# The bytes outside [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F] once A-Z are a-z; all others belong to words.
APART = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
CAPITALS, SMALL = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
ALPHANUMERIC = bytes.maketrans(APART + CAPITALS, b" " * len(APART) + SMALL)


def alphanumeric_words(text: bytes) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z as a-z."""
    return text.translate(ALPHANUMERIC).split()


def hashed(words: Sequence[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class Field:
    """A set of numbers as a bit field of a fixed size. A member is never missing; the fuller it is, the more others pass."""

    def __init__(self, numbers: DataFrame, column: str):
        spread = F.col(column).bitwiseXOR(F.shiftrightunsigned(F.col(column).cast("long"), 33) * F.lit(SPREAD))
        bits = numbers.select(spread.bitwiseAND((1 << FIELD_BITS) - 1).alias("bit")).select(
            F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, CAST(bit & 63 AS INT))").alias("mask")
        )
        # at most one row per 64 bits of the field
        rows = bits.groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
        self.words = np.zeros(1 << (FIELD_BITS - 6), np.int64)
        self.words[rows["at"].to_numpy()] = rows["mask"].to_numpy()

    def has(self, numbers: np.ndarray) -> np.ndarray:
        own = numbers.view(np.uint64)
        bit = ((own ^ ((own >> np.uint64(33)) * np.uint64(SPREAD))) & np.uint64((1 << FIELD_BITS) - 1)).view(np.int64)
        return (self.words[bit >> 6] >> (bit & 63) & 1).astype(bool)


def asked_for(table: DataFrame, key: str, wanted: DataFrame, column: str) -> DataFrame:
    """The rows of ``table`` whose number ``key`` is in the ``column`` of ``wanted``, and few others.

    Rows that nobody asks for are left where they lie, so a join with ``wanted`` after this moves only the rest.
    """
    return passing(table, key, Field(wanted, column))


def all_but(table: DataFrame, unwanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` whose number ``key`` is not in ``unwanted``. Only unwanted rows and few others are moved."""
    field = Field(unwanted, key)
    doubtful = passing(table, key, field).join(unwanted.select(key), key, "left_anti").select(*table.columns)
    return passing(table, key, field, others=True).unionAll(doubtful)


def passing(table: DataFrame, key: str, field: Field, others: bool = False) -> DataFrame:
    """The rows that the field has, or all ``others``."""
    python_workers(table.sparkSession)
    sent = table.sparkSession.sparkContext.broadcast(field)
    place = table.columns.index(key)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            yield batch.filter(pa.array(sent.value.has(batch.column(place).to_numpy()) != others))

    return table.mapInArrow(needed, table.schema)
