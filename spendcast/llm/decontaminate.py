"""Benchmark decontamination: hash windows of benchmark words, scan all training text for them, remove what is found.

The windows of the benchmark (``n`` words in a row, or a whole item with fewer) are hashed and sent to all tasks as a
sorted array. A task hashes every window of its texts by running sums, looks the hashes up, and compares the words of
what it finds with those of the item, so a chance agreement of hashes never counts. Texts are read once for every
million windows of the benchmark; a block of windows is all that is ever sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcast.llm.text import (
    ALPHANUMERIC,
    ROW_TAG,
    WordHashes,
    alphanumeric_words,
    hashed,
    map_columns,
    map_texts,
    steadily_tagged,
    without,
)
from spendcast.session import materialize

WINDOW = 10
# Windows sent to the tasks at a time: 8 bytes of hash, 8 of place and a word's letters for each, some 25 MB.
WINDOWS_AT_ONCE = 1 << 20
# Words of one row of the prepared benchmark, so that no row is unbounded.
PART_WORDS = 1 << 16
# The base of hashes of word sequences, and its inverse modulo 2^64.
BASE = 0xB5297A4D3F84D5B5
INVERSE = pow(BASE, -1, 1 << 64)
FOUND = "n_words long, first array<int>, last array<int>, n_hit long, items array<string>, cut binary"


class Block(NamedTuple):
    """Windows by length: sorted hashes, and the item part and first word of each, equal hashes side by side."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    names: list[str | None]
    texts: list[bytes]


class Rolling:
    """Hashes of all windows of a run of words."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(words * powers(BASE, n), out=self.sums[1:])
            self.back = powers(INVERSE, n)

    def windows(self, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (self.sums[length:] - self.sums[:-length]) * self.back[: max(len(self.sums) - length, 0)]
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
            return mixed ^ (mixed >> np.uint64(29))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def item_parts(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """``name``, ``words`` (one space apart) and ``n`` of every item, long ones in overlapping parts."""

    def split(texts: list[bytes]) -> tuple:
        places, words, sizes = [], [], []
        for place, value in enumerate(texts):
            found = alphanumeric_words(value)
            # a part starts with the words that the windows across its edge need
            for start in range(0, max(len(found) - window + 1, min(len(found), 1)), PART_WORDS):
                part = found[start : start + PART_WORDS + window - 1]
                places.append(place)
                words.append(b" ".join(part))
                sizes.append(len(part))
        return places, [words, sizes]

    named = items.select(F.col(f"`{item}`").cast("string").alias("name"), F.col(f"`{text}`").alias("text"))
    return map_texts(named, ["name"], "text", split, "words binary, n long")


def window_blocks(parts: DataFrame, window: int, at_once: int) -> Iterator[Block]:
    """Blocks of at most ``at_once`` windows, and a part more; the driver holds one of them and one task's parts."""
    names, texts, size = [], [], 0
    for r in parts.toLocalIterator():
        names.append(r["name"])
        texts.append(bytes(r["words"]))
        size += max(r["n"] - window + 1, 1)
        if size >= at_once:
            yield block_of(names, texts, window)
            names, texts, size = [], [], 0
    if texts:
        yield block_of(names, texts, window)


def block_of(names: list[str | None], texts: list[bytes], window: int) -> Block:
    known, listed = WordHashes(), {}
    for place, value in enumerate(texts):
        words = hashed(value.split(), known)
        length = min(window, len(words))
        found = Rolling(words).windows(length)
        listed.setdefault(length, []).append((found, np.full(len(found), place, np.int32), np.arange(len(found), dtype=np.int32)))
    by_length = {}
    for length, many in listed.items():
        hashes, part, start = (np.concatenate([x[i] for x in many]) for i in range(3))
        order = np.argsort(hashes, kind="stable")
        by_length[length] = hashes[order], part[order], start[order]
    return Block(by_length, names, texts)


class Scanner:
    """Finds the windows of a block in batches of texts."""

    def __init__(self, block: Block):
        self.block, self.known = block, WordHashes()
        # a small table says of most hashes that they are not among the windows
        self.near = {}
        for length, (hashes, *_) in block.by_length.items():
            self.near[length] = near = np.zeros(1 << 22, bool)
            near[hashes >> np.uint64(42)] = True
        self.words: dict[int, list[bytes]] = {}

    def item_words(self, part: int) -> list[bytes]:
        if part not in self.words:
            if len(self.words) > 10_000:
                self.words.clear()
            self.words[part] = self.block.texts[part].split()
        return self.words[part]

    def scan(self, texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, list[str]]]:
        """Of every text its words, first and last (excluded) word of each run of hit words, and the items found."""
        split = [alphanumeric_words(t) for t in texts]
        ends = np.cumsum([len(w) for w in split], dtype=np.int64)
        flat = [w for words in split for w in words]
        rolling = Rolling(hashed(flat, self.known))
        edges = np.zeros(len(flat) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for length, (hashes, part, start) in self.block.by_length.items():
            found = rolling.windows(length)
            at = np.flatnonzero(self.near[length][found >> np.uint64(42)])
            low = np.searchsorted(hashes, found[at])
            there = hashes[np.minimum(low, len(hashes) - 1)] == found[at]
            at, low = at[there], low[there]
            text_of = np.searchsorted(ends, at, side="right")
            inside = at + length <= ends[np.minimum(text_of, max(len(ends) - 1, 0))]
            at, low, text_of = at[inside], low[inside], text_of[inside]
            high = np.searchsorted(hashes, found[at], side="right")
            for a, x, y, t in zip(at.tolist(), low.tolist(), high.tolist(), text_of.tolist(), strict=True):
                words, hit = flat[a : a + length], False
                for p, s in zip(part[x:y].tolist(), start[x:y].tolist(), strict=True):
                    if self.item_words(p)[s : s + length] == words:
                        hit = True
                        if self.block.names[p] is not None:
                            items.setdefault(t, set()).add(self.block.names[p])
                if hit:
                    edges[a] += 1
                    edges[a + length] -= 1
        covered = np.cumsum(edges[:-1]) > 0
        for t, words in enumerate(split):
            own = covered[ends[t] - len(words) : ends[t]]
            turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            yield words, turns[::2], turns[1::2], sorted(items.get(t, ()))


def without_words(text: bytes, first: np.ndarray, last: np.ndarray) -> bytes:
    """The text without the given runs of words; what stands between words stays where it is."""
    plain = text.translate(ALPHANUMERIC)
    # word bounds by the change from blank to not blank, in bytes
    solid = np.frombuffer(plain, np.uint8) != 0x20
    turns = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    begins, stops, kept, end = turns[::2], turns[1::2], [], 0
    for a, b in zip(first, last, strict=True):
        kept.append(text[end : begins[a]])
        end = stops[b - 1]
    return b"".join([*kept, text[end:]])


def scanned(docs: DataFrame, carried: list[str], text: str, block: Block, only_hits: bool, cut: bool) -> DataFrame:
    """``carried`` columns and ``FOUND``. ``cut`` is the text without hits where it is asked for and has any."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    scanners: dict[int, Scanner] = {}

    def work(texts: list[bytes]) -> tuple:
        if not scanners:
            scanners[0] = Scanner(sent.value)
        places, out = [], [[] for _ in range(6)]
        for place, (words, first, last, items) in enumerate(scanners[0].scan(texts)):
            if only_hits and not len(first):
                continue
            places.append(place)
            left = without_words(texts[place], first, last) if cut and len(first) else None
            for column, value in zip(out, (len(words), first, last, int((last - first).sum()), items, left), strict=True):
                column.append(value)
        return places, out

    return map_texts(docs, carried, text, work, FOUND)


def find_benchmark(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str],
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    at_once: int = WINDOWS_AT_ONCE,
    cut: bool = False,
) -> DataFrame:
    """``keep`` columns of every document, and where benchmark items occur in it.

    ``n_words``; ``first`` and ``last`` (excluded), word numbers of each run of hit words; ``n_hit``; ``items``, the ids
    found, as strings; ``cut``, the bytes of the text without its hit words, NULL where nothing is hit or ``cut`` is not
    asked for. A NULL or empty text has no words and no hits; an item without words has no windows. An item whose id is
    NULL hits words but is not listed; items of one id count once. Repeated rows are rows of their own. An empty
    benchmark hits nothing, an empty table gives an empty one. Columns in ``keep`` may have any name.
    """
    parts = materialize(item_parts(items, item, item_text, window), "benchmark-parts")
    blocks = window_blocks(parts, window, at_once)
    block = next(blocks, Block({}, [], []))
    following = next(blocks, None)
    if following is None:
        return scanned(docs, keep, text, block, False, cut)
    # more windows than are sent at once: the texts are read once for every block, and their hits meet by row
    tag = ROW_TAG
    numbered = steadily_tagged(without(docs, tag))
    hits = []
    while block is not None:
        hits.append(materialize(scanned(numbered, [tag], text, block, True, False), "benchmark-hits"))
        block, following = following, next(blocks, None)
    every = hits[0]
    for more in hits[1:]:
        every = every.union(more)
    spans = F.flatten(F.collect_list(F.arrays_zip("first", "last"))).alias("spans")  # of one text
    met = every.groupBy(F.col(tag).alias("_hit_row")).agg(spans, F.array_distinct(F.flatten(F.collect_list("items"))).alias("_hit_items"))

    def merge(texts: list[bytes], spans: list, found: list) -> tuple:
        out = [[] for _ in range(6)]
        for value, own, names in zip(texts, spans, found, strict=True):
            n = len(alphanumeric_words(value))
            covered = np.zeros(n, bool)
            for s in own or ():
                covered[s["first"] : s["last"]] = True
            turns = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
            first, last = turns[::2], turns[1::2]
            left = without_words(value, first, last) if cut and len(first) else None
            for column, x in zip(out, (n, first, last, int(covered.sum()), sorted(names or ()), left), strict=True):
                column.append(x)
        return None, out

    joined = numbered.join(met, F.col(tag) == F.col("_hit_row"), "left")
    whole = F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b""))
    return map_columns(joined, keep, [whole, F.col("spans"), F.col("_hit_items")], merge, FOUND)


def decontaminated(
    docs: DataFrame, items: DataFrame, remove: str = "spans", text: str = "text", least_hit: int = 1, **options
) -> DataFrame:
    """The documents with their own columns, without what they hold of the benchmark.

    ``remove="spans"`` cuts the hit words out of the text, ``"documents"`` drops documents with ``least_hit`` hit words or
    more. All other rows and columns stay as they are; NULL texts stay NULL.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"spans or documents can be removed, not {remove!r}")
    found = find_benchmark(docs, items, docs.columns, text, cut=remove == "spans", **options)
    # by position: the documents' own columns come first, whatever their names
    own = [f"_own_{i}" for i in range(len(docs.columns))]
    placed = found.toDF(*own, "_n_words", "_first", "_last", "_n_hit", "_items", "_cut")
    if remove == "documents":
        return placed.where(F.col("_n_hit") < least_hit).select(*own).toDF(*docs.columns)
    at = own[docs.columns.index(text)]
    kind = docs.select(F.col(f"`{text}`")).schema[0].dataType
    less = F.coalesce(F.col("_cut").cast("string").cast(kind), F.col(at)).alias(at)
    return placed.select(*[less if c == at else c for c in own]).toDF(*docs.columns)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``."""
    found = find_benchmark(docs, items, [key], **options).toDF("_key", "n_words", "_first", "_last", "n_hit", "_items", "_cut")
    return found.select(
        F.col("_key").alias(key),
        "n_words",
        "n_hit",
        F.size("_items").cast("long").alias("n_items"),
        # the ids come sorted by code point
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
