"""Ranked lexical search over bit-sliced signatures.

**Index.** Documents of like size form blocks. A document's signature is a Bloom filter of its terms, and of the terms
that it holds 2, 4 and 8 times or more as keys of their own. A block keeps its signatures by bit and not by document:
a slice is the bitmap of the block's documents that have the bit. Behind the slices lie the documents' terms and counts.

**Search.** The slices of a term's bits, and-ed, name every document of the block that may hold it, and the slices of
its higher counts limit how often. Weights times the largest contributions that these limits permit add up to a bound
that no score exceeds. A document whose bound lies below the tenth-best score known for an item is proven to be out of
the item's results; all others are scored exactly from their own counts. The scores known at first come from a bounded
number of blocks; they only decide how much work is left, never what is found.

Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendcast.llm.text import ROW_TAG, WordHashes, alphanumeric_words, hashed, map_texts, python_workers, steadily_tagged, whole, without
from spendcast.session import materialize

TOP = 10
# A term sets so many bits; a signature has 8 to 16 bits for each of its keys.
HASHES, LEAST_BITS = 3, 8
# Documents of a block, and bytes of the batches in which blocks go to Python and back.
BLOCK_DOCS, BATCH_BYTES = 128, 8 << 20
# Counts from which a term has a further key. A bound takes the largest count below the next one.
LEVELS = (1, 2, 4, 8)
# Blocks from which first scores are taken; items and terms of items compared in one reading of the index.
PILOTS, ITEMS_AT_ONCE, TERMS_AT_ONCE = 256, 1024, 1 << 15
# Fixed values of the score: free share of a document's length, and the units of its integer arithmetic.
LENGTH_SHARE, UNIT = 90, 1000
MULTIPLIERS = [pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(HASHES * len(LEVELS))]


class Index(NamedTuple):
    """``blocks`` of signatures and counts, ``vocabulary`` (``hash``, ``df``), and the documents and terms in all."""

    blocks: DataFrame
    vocabulary: DataFrame
    n_docs: int
    n_terms: int


def bit_places(hashes: np.ndarray, level: int, log_bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        mixed = [hashes * np.uint64(m) for m in MULTIPLIERS[level * HASHES : (level + 1) * HASHES]]
        return [((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - log_bits) for x in mixed]


def signature_slices(terms: list[tuple[np.ndarray, np.ndarray]], log_bits: int) -> bytes:
    """The slices of some documents, given the hashes and counts of each."""
    bits = np.zeros((len(terms), 1 << log_bits), bool)
    for row, (hashes, counts) in zip(bits, terms, strict=True):
        for level, least in enumerate(LEVELS):
            for places in bit_places(hashes[counts >= least], level, log_bits):
                row[places] = True
    return np.packbits(bits.T, axis=1).tobytes()


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Read every whole text once and write the index. Documents without a term are not in it.

    Keys of any type that can be sorted are kept in Arrow and stay as they are, NULL among them.
    """
    python_workers(docs.sparkSession)
    # blocks are large rows
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kind = docs.select(F.col(f"`{key}`")).schema[0].dataType
    schema = T.StructType.fromDDL("block long, log_bits int, lengths binary, sizes binary, slices binary, hashes binary, counts binary")
    schema = schema.add("keys", T.ArrayType(kind))
    arrow = to_arrow_schema(schema)
    known, made = WordHashes(), [0]  # blocks of the task

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            by_bits: dict[int, list] = {}
            for place, value in enumerate(batch.column(1).to_pylist()):
                words = alphanumeric_words(value)
                if not words:
                    continue
                hashes, counts = np.unique(hashed(words, known), return_counts=True)
                entries = sum(int((counts >= least).sum()) for least in LEVELS)
                log_bits = math.ceil(math.log2(LEAST_BITS * entries))
                by_bits.setdefault(log_bits, []).append((place, len(words), hashes, counts.astype(np.uint32)))
            rows = []
            parts = [(b, m[i : i + BLOCK_DOCS]) for b, m in sorted(by_bits.items()) for i in range(0, len(m), BLOCK_DOCS)]
            for log_bits, members in parts:
                places, lengths, hashes, counts = zip(*members, strict=True)
                rows.append(
                    (
                        task | made[0] + len(rows),
                        log_bits,
                        np.array(lengths, np.int64).tobytes(),
                        np.array([len(h) for h in hashes], np.int64).tobytes(),
                        signature_slices(list(zip(hashes, counts, strict=True)), log_bits),
                        np.concatenate(hashes).tobytes(),
                        np.concatenate(counts).tobytes(),
                        list(places),
                    )
                )
            made[0] += len(rows)
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True))[:-1], arrow, strict=False)]
                order = pa.array([p for r in rows for p in r[-1]], pa.int64())
                edges = pa.array(np.cumsum([0, *[len(r[-1]) for r in rows]]), pa.int32())
                keys = pa.ListArray.from_arrays(edges, batch.column(0).take(order), type=arrow.field("keys").type)
                for at in range(len(rows)):  # one block at a time: a batch of blocks may be large
                    yield pa.RecordBatch.from_arrays([*[c.slice(at, 1) for c in columns], keys.slice(at, 1)], schema=arrow)

    read = docs.select(F.col(f"`{key}`").alias("key"), whole(f"`{text}`").cast("binary").alias("text"))
    table = materialize(read.mapInArrow(blocks, schema), "lexical-blocks")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist()]
            found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["hash", "df"])

    vocabulary = table.select("hashes").mapInArrow(terms, "hash long, df long").groupBy("hash").agg(F.sum("df").alias("df"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, parts))], pa.int64()), pa.array([sum(int(p.sum()) for p in parts)], pa.int64())], ["n", "l"])

    n, total = table.select("lengths").mapInArrow(lengths, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return Index(table, materialize(vocabulary, "lexical-vocabulary"), n or 0, total or 0)


class Items:
    """Some items to be searched for: their distinct terms, weights, and the terms of each."""

    def __init__(self, numbers: list[int], terms: list[list[tuple[int, int]]], index: Index):
        self.numbers = np.array(numbers, np.int64)
        weights = {}
        for found in terms:
            for h, df in found:
                weights[h] = math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df + 1)))
        signed = np.array(sorted(weights), np.int64)
        self.hashes, self.weights = signed.view(np.uint64), np.array([weights[h] for h in signed.tolist()], np.int64)
        flat = np.searchsorted(signed, np.array([h for found in terms for h, _ in found], np.int64))
        self.terms = flat
        self.starts = np.cumsum([0, *[len(t) for t in terms]])[:-1]
        self.n_docs, self.n_terms = index.n_docs, index.n_terms

    def per_item(self, of_terms: np.ndarray) -> np.ndarray:
        """Sums over each item's terms."""
        return np.add.reduceat(of_terms[self.terms], self.starts, axis=0)


def contribution(counts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (UNIT**3 * counts) // (UNIT * counts + 8 * scale)


class Block:
    """One block of the index beside some items."""

    def __init__(self, row: dict, items: Items):
        self.items, self.log_bits = items, row["log_bits"]
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.n = len(self.lengths)
        self.slices = np.frombuffer(row["slices"], np.uint8).reshape(1 << self.log_bits, -1)
        self.edges = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
        self.hashes = np.frombuffer(row["hashes"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.uint32)
        # whole numbers without limit, then 64 bits
        scale = [100 - LENGTH_SHARE + LENGTH_SHARE * n * items.n_docs // items.n_terms for n in self.lengths.tolist()]
        self.scale = np.array(scale, np.int64)

    def bounds(self, places: list[list[np.ndarray]]) -> np.ndarray:
        """Of every item and document a number that the score does not exceed."""
        most = np.zeros((len(self.items.hashes), self.n), np.int64)
        present, before = None, np.zeros(self.n, np.int64)
        for level, of_level in enumerate(places):
            maybe = self.slices[of_level[0]]
            for p in of_level[1:]:
                maybe = maybe & self.slices[p]
            present = maybe if present is None else present & maybe
            rows = np.flatnonzero(present.any(axis=1))
            largest = self.lengths if level + 1 == len(LEVELS) else np.minimum(LEVELS[level + 1] - 1, self.lengths)
            up_to = contribution(largest, self.scale)
            bits = np.unpackbits(present[rows], axis=1, count=self.n)
            most[rows] += bits * np.maximum(up_to - before, 0)
            before = np.maximum(up_to, before)
        return self.items.per_item(most * self.items.weights[:, None])

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """The exact scores of some documents for all items."""
        out = np.zeros((len(docs), len(self.items.numbers)), np.int64)
        wanted = self.items.hashes
        for row, d in zip(out, docs.tolist(), strict=True):
            own = self.hashes[self.edges[d] : self.edges[d + 1]]
            at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            there = own[at] == wanted
            counts = np.where(there, self.counts[self.edges[d] : self.edges[d + 1]][at], 0).astype(np.int64)
            row[:] = self.items.per_item(self.items.weights * contribution(counts, self.scale[d]))
        return out


def scored(blocks: DataFrame, items: Items, least: np.ndarray, top: int, pilot: bool) -> DataFrame:
    """``number`` (of the item), ``score``, ``key`` and ``rescored`` of documents that may be among an item's best.

    ``least`` is a score that ``top`` documents of the item reach, or 0. A pilot scores each block's highest bounds only.
    """
    kind = blocks.schema["keys"].dataType.elementType
    schema = T.StructType.fromDDL("number long, score long, rescored long").add("key", kind)
    arrow = to_arrow_schema(schema)
    sent = blocks.sparkSession.sparkContext.broadcast((items, least))
    names = [f.name for f in blocks.schema]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, floor = sent.value
        # the best scores that this task has seen, per item, lowest first
        best = np.zeros((len(own.numbers), top), np.int64)
        by_bits: dict[int, list] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(i)[at].as_py() for i, n in enumerate(names) if n != "keys"}
                block, log_bits = Block(row, own), row["log_bits"]
                if log_bits not in by_bits:
                    by_bits[log_bits] = [bit_places(own.hashes, level, log_bits) for level in range(len(LEVELS))]
                bounds = block.bounds(by_bits[log_bits])
                limit = np.maximum(np.maximum(best[:, 0], floor), 1)
                open_ = bounds >= limit[:, None]
                if pilot and block.n > top:
                    # of each item the highest bounds of the block
                    open_ &= bounds >= np.partition(bounds, block.n - top, axis=1)[:, block.n - top][:, None]
                docs = np.flatnonzero(open_.any(axis=0))
                if not len(docs):
                    continue
                scores = block.scores(docs).T
                keys = batch.column(len(names) - 1)[at].values.take(pa.array(docs))
                order = np.array(pc.rank(keys, sort_keys="ascending", null_placement="at_end", tiebreaker="first"), np.int64)
                use = scores >= limit[:, None]
                if len(docs) > top:
                    # the block's own best of each item: scores first, then the order of keys
                    by_key = np.argsort(order, kind="stable")
                    ranked = np.argsort(-scores[:, by_key], axis=1, kind="stable")[:, :top]
                    mine = np.zeros_like(use)
                    np.put_along_axis(mine, by_key[ranked], True, axis=1)
                    use &= mine
                i, d = np.nonzero(use)
                found = np.where(use, scores, 0)
                best = np.sort(np.concatenate([best, np.sort(found, axis=1)[:, -top:]], axis=1), axis=1)[:, -top:]
                columns = [pa.array(own.numbers[i]), pa.array(scores[i, d]), pa.array(np.full(len(i), len(docs)), pa.int64()), keys.take(pa.array(d))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return blocks.mapInArrow(search, schema)


def best_of(found: DataFrame, top: int) -> DataFrame:
    """``number, rank, key, score``: the best of every item, equal scores by ascending key, NULL last."""
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("number", "rank", "key", "score")


def item_blocks(terms: DataFrame, index: Index) -> Iterator[Items]:
    """Items in blocks of a bounded number of items and terms, and one item more."""
    numbers, found, size = [], [], 0
    for r in terms.toLocalIterator():
        numbers.append(r["number"])
        found.append([(t["hash"], t["df"]) for t in r["terms"]])
        size += len(found[-1])
        if size >= TERMS_AT_ONCE or len(numbers) >= ITEMS_AT_ONCE:
            yield Items(numbers, found, index)
            numbers, found, size = [], [], 0
    if numbers:
        yield Items(numbers, found, index)


def search(index: Index, items: DataFrame, item: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """The ``top`` documents of every row of ``items`` with a score above 0: ``item``, ``rank``, ``key``, ``score``.

    Equal scores are in ascending order of keys, NULL last; equal keys in any order. An item that is NULL, empty or without
    a term of the corpus has no rows. Repeated items have rows each. The index is read once for every block of items.
    """
    numbered = steadily_tagged(without(items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")), ROW_TAG))
    known = WordHashes()

    def terms(texts: list[bytes]) -> tuple:
        places, hashes = [], []
        for place, value in enumerate(texts):
            own = np.unique(hashed(alphanumeric_words(value), known)).view(np.int64)
            places += [place] * len(own)
            hashes.append(own)
        return places, [np.concatenate([np.zeros(0, np.int64), *hashes])]

    each = map_texts(numbered, [ROW_TAG], "text", terms, "hash long")
    each = each.join(index.vocabulary, "hash").withColumnRenamed(ROW_TAG, "number")
    per_item = materialize(each.groupBy("number").agg(F.collect_list(F.struct("hash", "df")).alias("terms")), "item-terms")
    n_blocks = index.blocks.count()
    results = []
    for some in item_blocks(per_item, index):
        least = np.zeros(len(some.numbers), np.int64)
        pilots = index.blocks.where(F.pmod(F.xxhash64("block"), F.lit(max(n_blocks, 1))) < PILOTS)
        first = best_of(scored(pilots, some, least, top, True), top).where(F.col("rank") == top)
        tenth = {r["number"]: r["score"] for r in first.collect()}  # at most one row per item of the block
        least = np.array([tenth.get(i, 0) for i in some.numbers.tolist()], np.int64)
        results.append(materialize(best_of(scored(index.blocks, some, least, top, False), top), "lexical-results"))
    if not results:
        empty = f"number long, rank int, key {index.blocks.schema['keys'].dataType.elementType.simpleString()}, score long"
        results.append(items.sparkSession.createDataFrame([], empty))
    every = results[0]
    for more in results[1:]:
        every = every.union(more)
    named = every.join(numbered.select(F.col(ROW_TAG).alias("number"), "item"), "number")
    return named.select(F.col("item").alias(item), "rank", "key", "score")


def ranked_documents(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP
) -> DataFrame:
    """``item``, ``rank``, ``key`` and ``score`` of the ``top`` documents of every item.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z as a-z. NULL and empty texts have
    none and are neither counted nor found. Repeated documents are documents of their own. An empty table on either side
    gives an empty result. Other columns, whatever their names, are not read.
    """
    found = search(build_index(docs, key, text), items, item, item_text, top)
    return found.toDF(item, "rank", key, "score")
