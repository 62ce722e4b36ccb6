"""Repeated passages: paragraphs are banded by MinHash, aligned word by word, and clustered by components.

**Paragraphs and bands.** Every ``PARAGRAPH_WORDS`` words in a row are a paragraph, wherever sentences begin or end. Its
signature is the least hash of its five-word shingles, one value in one band: neighbours mostly have the same, so
paragraphs in a row with one value are one row, about one for nine words. A passage has dozens of paragraphs, each with a
chance of its own, which makes recall high with a single band: a passage is found with certainty if as many words in a
row as a paragraph has were left as they are.

**Colliding paragraphs.** Stretches of paragraphs with a value found once are left at once. Equal stretches are counted
as one; of a value with different ones, each is taken apart once and its paragraphs are counted. So every repeated
paragraph gets the place that holds it first, and no pairs are made, however many texts hold it.

**Alignment.** Repeated paragraphs in a row with one holder are a run; runs with few words between them are a chain. A
chain is carried on at both ends, over words that were changed, put in or left out, through up to ``REACH`` words of both
texts. The longest alignment whose five-word shingles, told apart by place, have a Jaccard similarity of ``SIMILAR``
percent or more is a link of two passages. Runs are equal word by word, whatever their length.

**Clusters.** Components of linked passages; the first one, by the order of keys, is kept, the others are removed. Words
of which every paragraph is repeated are removed as well, even if no single text holds them all.

An edited passage is compared with the first holder of each of its unchanged paragraphs, not with all holders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendcast.llm.components import components
from spendcast.llm.text import ROW_TAG, Field, asked_for, map_columns, python_workers, tagged, without, word_hashes
from spendcast.session import freed, materialize

FIND_WORDS = re.compile("[^\x20\x09-\x0d]+")
WORDS_PER_SHINGLE = 5
# Percent of shared shingles.
SIMILAR = 80
# Words of a paragraph, and words a passage has to have to be removed.
PARAGRAPH_WORDS = 20
SPAN_WORDS = 30
# Words beyond a chain's ends that alignment looks at, and the most words in a row that an edit changes on one side.
REACH = 40
EDIT_WORDS = 6
# Words of a block that are worked on at once; a longer text is a block of its own.
BLOCK_WORDS = 400_000
# The base of hashes of word sequences, and its inverse modulo 2^64.
BASE = 0x9FB21C651E98DF25
INVERSE = pow(BASE, -1, 1 << 64)
# Bits of a number that tell apart the bytes of one written partition.
PARTITION_BITS = 40


@lru_cache(maxsize=4)
def powers(base: int, doublings: int) -> np.ndarray:
    out = np.full(1 << doublings, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def numbered_by_key(docs: DataFrame, key: str | None, text: str) -> DataFrame:
    """The documents in the order of their keys, NULL last, with ``_row_tag``, written once.

    Numbers ascend with the order, and a text has as many numbers to itself as it has bytes and one: number plus place of
    a word is one number for every word of the table. Rows with one key are in the order of the scan.
    """
    before = tagged(without(docs, ROW_TAG))
    order = [F.col(ROW_TAG)] if key is None else [F.col(f"`{key}`").asc_nulls_last(), F.col(ROW_TAG)]
    before = before.orderBy(*order).drop(ROW_TAG)
    names = [*before.columns, ROW_TAG]
    kinds = T.StructType(
        [T.StructField(f"_{i}", f.dataType) for i, f in enumerate(before.schema)] + [T.StructField("_size", T.LongType())]
    )
    arrow = to_arrow_schema(kinds)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << PARTITION_BITS
        for batch in batches:
            sizes = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) + 1
            ends = at + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ends - sizes, pa.int64())], schema=arrow)
            at = int(ends[-1]) if len(ends) else at

    python_workers(docs.sparkSession)
    size = F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long")
    asked = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(before.columns)]
    return materialize(before.select(*asked, size.alias("_size")).mapInArrow(number, kinds).toDF(*names), "numbered")


class Stretches:
    """Paragraphs in a row with one least shingle, of some texts: value, text, first word, how many."""

    def __init__(self, words: np.ndarray, sizes: Sequence[int], paragraph: int):
        n, self.paragraph = len(words), paragraph
        sizes = np.asarray(sizes, np.int64)
        ends = np.cumsum(sizes)
        at = np.arange(max(n - paragraph + 1, 0))
        text = np.repeat(np.arange(len(sizes)), sizes)
        at = at[at + paragraph <= ends[text[: len(at)]]]
        if not len(at):
            self.key = self.words = np.zeros(0, np.uint64)
            self.text = self.first = self.many = self.start = np.zeros(0, np.int64)
            return
        with np.errstate(over="ignore"):
            count = n - WORDS_PER_SHINGLE + 1
            mixed = np.full(count, np.uint64(0x2545F4914F6CDD1D))
            for i in range(WORDS_PER_SHINGLE):
                mixed = (mixed ^ words[i : count + i]) * np.uint64(0xFF51AFD7ED558CCD)
                mixed ^= mixed >> np.uint64(32)
            least = sliding_least(mixed, paragraph - WORDS_PER_SHINGLE + 1)[at]
            new = np.append(True, (least[1:] != least[:-1]) | (np.diff(at) != 1))
            # no more paragraphs than one has words, so that a stretch of one repeated shingle has a bound
            run = np.flatnonzero(new)
            new |= (np.arange(len(at)) - run[np.cumsum(new) - 1]) % paragraph == 0
            run = np.flatnonzero(new)
            self.many = np.diff(np.append(run, len(at)))
            self.key, self.start = least[run], at[run]
            self.text = text[self.start]
            self.first = self.start - (ends - sizes)[self.text]
            self.words = words

    @cached_property
    def sums(self) -> np.ndarray:
        sums = np.zeros(len(self.words) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.words * powers(BASE, self.doublings)[: len(self.words)], out=sums[1:])
        return sums

    @property
    def doublings(self) -> int:
        return max(len(self.words).bit_length(), BLOCK_WORDS.bit_length())

    def digests(self, chosen: np.ndarray) -> np.ndarray:
        """What tells apart the words of the chosen stretches."""
        starts = self.start[chosen]
        return stirred(self.sequences(starts, starts + self.many[chosen] + self.paragraph - 1))

    def sequences(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the words of each range: equal words in equal order give an equal one, wherever they stand."""
        with np.errstate(over="ignore"):
            return stirred((self.sums[ends] - self.sums[starts]) * powers(INVERSE, self.doublings)[starts])

    def apart(self, chosen: np.ndarray) -> np.ndarray:
        """The hashes of all paragraphs of the chosen stretches, in a row."""
        many = self.many[chosen]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        starts = np.repeat(self.start[chosen], many) + place
        return self.sequences(starts, starts + self.paragraph)


def blocks(texts: list) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """The first text, word hashes and sizes of texts in a row."""
    first, sizes, words = 0, [], []
    for i, value in enumerate(texts):
        own = value.split() if value else []
        words += own
        sizes.append(len(own))
        if len(words) >= BLOCK_WORDS or i + 1 == len(texts):
            yield first, word_hashes(words), sizes
            first, sizes, words = i + 1, [], []


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def scanned(numbered: DataFrame, text: str, work, made: str, paragraph: int) -> DataFrame:
    """``work(rows, stretches)`` of all texts, as record batches of the columns ``made``."""
    python_workers(numbered.sparkSession)
    schema = to_arrow_schema(T.StructType.fromDDL(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for first, words, sizes in blocks(batch.column(1).to_pylist()):
                found = work(rows[first : first + len(sizes)], Stretches(words, sizes, paragraph))
                yield pa.RecordBatch.from_arrays(found, schema=schema)

    named = numbered.select(F.col(ROW_TAG).alias("row"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    return named.mapInArrow(run, made)


def occurrences(numbered: DataFrame, text: str, paragraph: int = PARAGRAPH_WORDS) -> DataFrame:
    """``key, digest, row, first, many`` of stretches whose value may be found twice; ``inside``: paragraph hashes, or none.

    A paragraph is told apart by its value and 32 bits more.

    Values found twice are told to the tasks by a bit field of a fixed size. Where it is full, more stretches are let
    through, and left later. Of equal stretches of a batch, one has the hashes.
    """

    def count(rows: np.ndarray, s: Stretches) -> list:
        own, n = np.unique(s.key, return_counts=True)
        return [signed(own), pa.array(np.minimum(n, 2), pa.int64())]

    every = scanned(numbered, text, count, "key long, n long", paragraph).groupBy("key").agg(F.sum("n").alias("n"))
    shared = materialize(every.where("n > 1").select("key"), "shared-values")
    sent = numbered.sparkSession.sparkContext.broadcast(Field(shared, "key"))

    def place(rows: np.ndarray, s: Stretches) -> list:
        good = np.flatnonzero(sent.value.has(s.key))
        digest = s.digests(good)
        _, one = np.unique(digest, return_index=True)
        sizes = np.zeros(len(good), np.int64)
        sizes[one] = s.many[good[one]]
        hashes = s.apart(good[np.sort(one)]) if len(good) else np.zeros(0, np.uint64)
        inside = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(hashes.astype(np.uint32).view(np.int32)))
        numbers = [pa.array(x[good], pa.int64()) for x in (s.first, s.many)]
        return [signed(s.key[good]), signed(digest), pa.array(rows[s.text[good]], pa.int64()), *numbers, inside]

    made = "key long, digest long, row long, first long, many long, inside array<int>"
    return materialize(scanned(numbered, text, place, made, paragraph), "stretches")


def repeated_paragraphs(found: DataFrame) -> DataFrame:
    """``key, digest, holder, begin, from, to``: of equal stretches, the paragraphs that another place holds.

    ``from`` to ``to`` are paragraphs of the stretch. They are first held by the text ``holder``; ``begin`` is the number
    at which the stretch would begin there.
    """
    place = F.col("row") + F.col("first")
    each = found.groupBy("key", "digest").agg(
        F.min(place).alias("low"), F.max(place).alias("high"), F.min("row").alias("holder"), F.min("many").alias("many")
    )
    each = materialize(each, "different-stretches")
    told = each.groupBy("key").agg(F.count(F.lit(1)).alias("different"))
    each = each.join(told, "key")
    # all paragraphs of a value with one stretch are held wherever it is found
    ends = [F.lit(0).cast("long").alias("from"), (F.col("many") - 1).alias("to")]
    alone = each.where("different = 1 AND low < high").select("key", "digest", "holder", F.col("low").alias("begin"), *ends)
    unlike = each.where("different > 1").select("key", "digest", "low", "high", "holder")
    hashes = found.where(F.size("inside") > 0).select("key", "digest", "inside")
    # equal stretches of different batches come more than once, which changes no least and no greatest place
    apart = hashes.join(unlike, ["key", "digest"]).select("key", "digest", "low", "high", "holder", F.posexplode("inside").alias("nth", "paragraph"))
    apart = apart.select("key", "digest", "nth", "paragraph", "holder", (F.col("low") + F.col("nth")).alias("low"), (F.col("high") + F.col("nth")).alias("high"))
    apart = materialize(apart, "paragraphs")
    held = apart.groupBy("key", "paragraph").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("holder").alias("holder"))
    held = held.where("low < high").drop("high")
    parts = apart.select("key", "digest", "nth", "paragraph").join(held, ["key", "paragraph"])
    # places with one begin are held in a row: a stretch has no more paragraphs than a paragraph has words
    parts = parts.groupBy("key", "digest", "holder", (F.col("low") - F.col("nth")).alias("begin")).agg(
        F.min("nth").cast("long").alias("from"), F.max("nth").cast("long").alias("to")
    )
    return materialize(alone.unionByName(parts), "repeated-paragraphs")


def runs(found: DataFrame, repeated: DataFrame, paragraph: int) -> DataFrame:
    """``row, first, last, holder, at``: words that are held first at word ``at`` of the text ``holder``."""
    there = found.select("key", "digest", "row", "first").join(repeated, ["key", "digest"])
    there = there.where(F.col("row") + F.col("first") != F.col("begin"))
    return there.select(
        "row",
        (F.col("first") + F.col("from")).alias("first"),
        (F.col("first") + F.col("to") + paragraph).alias("last"),
        "holder",
        (F.col("begin") + F.col("from") - F.col("holder")).alias("at"),
    )


def covered(spans: np.ndarray, together: int) -> list[list[int]]:
    """Spans ``first, last, least`` in order; those that share ``together`` words or more are one."""
    out: list[list[int]] = []
    for first, last, least in spans[np.argsort(spans[:, 0], kind="stable")].tolist():
        if out and first <= out[-1][1] - together:
            out[-1][1] = max(out[-1][1], last)
            out[-1][2] = min(out[-1][2], least)
        else:
            out.append([first, last, least])
    return out


def enough(shared: int, left: int, right: int) -> bool:
    """Whether passages of so many words are similar, shingles told apart by place."""
    shingles = left + right - 2 * (WORDS_PER_SHINGLE - 1)
    return 100 * shared >= SIMILAR * (shingles - shared)


def chains(of_text: np.ndarray, paragraph: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``first, last, holder, at, to, shared`` of runs (``first, last, holder, at``) with few words between them."""
    first, last, holder, at = of_text.T
    order = np.lexsort((first, at - first, holder))
    whole: list[list[int]] = []
    for a, z, h, b in of_text[order].tolist():
        before = whole[-1] if whole else None
        if before and before[2] == h and before[3] - before[0] == b - a and a <= before[1] - paragraph + 1:
            before[1] = max(before[1], z)
        else:
            whole.append([a, z, h, b])
    whole.sort(key=lambda r: (r[2], r[0], r[1]))
    chain: list[int] = []
    for a, z, h, b in whole:
        to, shared = b + z - a, z - a - WORDS_PER_SHINGLE + 1
        if chain:
            x, y, other, u, v, have = chain
            twice = max(y - a, v - b, 0)
            more = have + shared - (twice and twice - WORDS_PER_SHINGLE + 1 if twice >= WORDS_PER_SHINGLE else 0)
            near = other == h and 0 <= z - y and 0 <= to - v and a - y <= REACH and b - v <= REACH
            near = near and abs((b - a) - (v - y)) <= EDIT_WORDS * 4
            if near and enough(more, z - x, to - u):
                chain = [x, z, h, u, to, more]
                continue
            yield tuple(chain)
        chain = [a, z, h, b, to, shared]
    if chain:
        yield tuple(chain)


def linked_chains(every: DataFrame, paragraph: int, span_words: int) -> DataFrame:
    """``row, first, last, holder, at, to, shared`` of chains, and (``shared`` NULL) words of which every paragraph is repeated."""
    per_text = every.groupBy("row").agg(F.collect_list(F.struct("first", "last", "holder", "at")).alias("runs"))  # of one text

    def work(rows: list, found: list) -> tuple:
        places, out = [], [[] for _ in range(6)]
        for i, (row, entries) in enumerate(zip(rows, found, strict=True)):
            own = np.array([(r["first"], r["last"], r["holder"], r["at"]) for r in entries], np.int64)
            told = [(a, z, h, None, None, None) for a, z, h in covered(own[:, :3], paragraph - 1) if z - a >= span_words]
            others = own[own[:, 2] != row]
            told += chains(others, paragraph) if len(others) else []
            places += [i] * len(told)
            for column, values in zip(out, zip(*told, strict=True), strict=False):
                column += values
        return places, out

    made = "first long, last long, holder long, at long, to long, shared long"
    return materialize(map_columns(per_text, ["row"], [F.col("row"), F.col("runs")], work, made), "chains")


def words_beside(numbered: DataFrame, asked: DataFrame, text: str) -> DataFrame:
    """``number, left, words``: hashes of words before (``left``) and after places of texts."""
    per_text = asked.distinct().groupBy("row").agg(F.collect_list(F.struct("at", "left")).alias("asked"))  # of one text
    per_text = materialize(per_text, "asked-places")
    texts = numbered.select(F.col(ROW_TAG).alias("_row"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    # texts that nothing is asked of mostly stay where they are
    texts = asked_for(texts, "_row", per_text, "row")
    placed = texts.join(per_text, F.col("_row") == F.col("row"))

    def work(texts: list, rows: list, asked: list) -> tuple:
        places, numbers, lefts, out = [], [], [], []
        for i, (value, row, wanted) in enumerate(zip(texts, rows, asked, strict=True)):
            words = word_hashes(value.split()).astype(np.uint32)
            for w in wanted:
                at, left = w["at"], w["left"]
                places.append(i)
                numbers.append(row + at)
                lefts.append(left)
                out.append((words[max(at - REACH, 0) : at] if left else words[at : at + REACH]).tobytes())
        return places, [numbers, lefts, out]

    inputs = [F.col(c) for c in ("text", "row", "asked")]
    found = map_columns(placed, [], inputs, work, "number long, left boolean, words binary")
    # where a text begins or ends there is nothing beside
    return materialize(found.where(F.length("words") > 0), "words-beside")


def carried_on(x: list[int], y: list[int]) -> list[tuple[int, int, int]]:
    """Ends of blocks of equal words from the front of both lists, over small edits: words of ``x``, of ``y``, shared shingles.

    The first block continues the words before the lists; later ones have their own shingles only.
    """
    out, i, j, shared, joined = [], 0, 0, 0, True
    while True:
        n = 0
        while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
            n += 1
        i, j = i + n, j + n
        shared += n if joined else max(n - WORDS_PER_SHINGLE + 1, 0)
        if n:
            out.append((i, j, shared))
        joined = False
        for skipped in range(1, 2 * EDIT_WORDS + 1):
            for p in range(max(0, skipped - EDIT_WORDS), min(skipped, EDIT_WORDS) + 1):
                q = skipped - p
                # two words in a row tell an exchange of one word, more are asked of other edits
                ask = 2 if p == q == 1 else 4
                if x[i + p : i + p + ask] == y[j + q : j + q + ask] and min(len(x) - i - p, len(y) - j - q) >= ask:
                    break
            else:
                continue
            break
        else:
            return out
        i, j = i + p, j + q


def aligned(numbered: DataFrame, every: DataFrame, text: str, span_words: int) -> DataFrame:
    """``row, first, last, holder, at, to`` of chains carried on as far as both passages stay similar."""
    every = every.where("shared IS NOT NULL")
    sides = [("row", "first", True), ("row", "last", False), ("holder", "at", True), ("holder", "to", False)]
    asked = [every.select(F.col(row).alias("row"), F.col(at).alias("at"), F.lit(left).alias("left")) for row, at, left in sides]
    beside = words_beside(numbered, reduce(DataFrame.union, asked), text)
    joined = every
    for name, (row, at, left) in zip(("before", "after", "there_before", "there_after"), sides, strict=True):
        found = beside.where(F.col("left") == left).select(F.col("number").alias(f"_{name}"), F.col("words").alias(name))
        joined = joined.join(found, F.col(row) + F.col(at) == F.col(f"_{name}"), "left").drop(f"_{name}")
    names = ["first", "last", "at", "to", "shared", "before", "after", "there_before", "there_after"]

    def work(*columns: list) -> tuple:
        places, out = [], [[], [], [], []]
        for i, (a, z, b, to, shared, *sides) in enumerate(zip(*columns, strict=True)):
            before, after, other_before, other_after = (np.frombuffer(s or b"", np.uint32).tolist() for s in sides)
            lefts = [(0, 0, 0), *carried_on(before[::-1], other_before[::-1])]
            rights = [(0, 0, 0), *carried_on(after, other_after)]
            best = (0, 0, 0, 0, 0)
            for p, q, r in lefts:
                for s, t, u in rights:
                    mine, theirs = z - a + p + s, to - b + q + t
                    if mine > best[0] and enough(shared + r + u, mine, theirs):
                        best = (mine, a - p, z + s, b - q, to + t)
            if best[0] >= span_words and best[4] - best[3] >= span_words:
                places.append(i)
                for column, value in zip(out, best[1:], strict=True):
                    column.append(value)
        return places, out

    made = "first long, last long, at long, to long"
    asked = joined.select("row", "holder", *[F.col(n).alias(f"in_{n}") for n in names])
    return materialize(map_columns(asked, ["row", "holder"], [F.col(f"in_{n}") for n in names], work, made), "passages")


def clustered(links: DataFrame) -> DataFrame:
    """``row, first, last, first_row, removed`` of linked passages: the first of each component is kept."""
    node = F.xxhash64("row", "first", "last").alias("node")
    held = links.select(F.col("holder").alias("row"), F.col("at").alias("first"), F.col("to").alias("last"))
    nodes = links.select("row", "first", "last").union(held).distinct().withColumn("node", node)
    nodes = materialize(nodes, "linked-passages")
    roots = components(links.select(node, F.xxhash64("holder", "at", "to").alias("other")))
    rooted = materialize(nodes.join(roots, "node"), "clusters")
    firsts = rooted.groupBy("root").agg(F.min(F.struct("row", "first", "last")).alias("least"))
    told = rooted.join(firsts, "root")
    return told.select(
        "row", "first", "last", F.col("least.row").alias("first_row"), (F.struct("row", "first", "last") != F.col("least")).alias("removed")
    )


def repeated_spans(numbered: DataFrame, text: str = "text", paragraph: int = PARAGRAPH_WORDS, span_words: int = SPAN_WORDS) -> DataFrame:
    """``row``, ``first``, ``last`` (words from 0, end excluded), ``first_row`` and ``removed`` of repeated passages.

    ``numbered`` comes from ``numbered_by_key``. The first row of a cluster keeps the passage (``removed`` is false there).
    """
    if not WORDS_PER_SHINGLE <= paragraph <= span_words:
        raise ValueError("a paragraph has five words at least, and no more than a span")
    spark = numbered.sparkSession
    with freed(spark) as scratch:
        found = occurrences(numbered, text, paragraph)
        with freed(spark) as inner:
            repeated = inner.keep(repeated_paragraphs(found))
        every = scratch.keep(linked_chains(runs(found, repeated, paragraph), paragraph, span_words))
    with freed(spark) as scratch:
        passages = scratch.keep(aligned(numbered, every, text, span_words))
    exact = every.where("shared IS NULL").select("row", "first", "last", F.col("holder").alias("first_row"), F.lit(True).alias("removed"))
    told = clustered(passages).union(exact)
    # at most one span per word of a text
    told = told.groupBy("row", "removed", "first").agg(F.max("last").alias("last"), F.min("first_row").alias("least"))
    per_text = told.groupBy("row", "removed").agg(F.collect_list(F.struct("first", "last", "least")).alias("spans"))

    def merge(spans: list) -> tuple:
        merged = [covered(np.array([(s["first"], s["last"], s["least"]) for s in of_text], np.int64), 0) for of_text in spans]
        places = [i for i, m in enumerate(merged) for _ in m]
        return places, [[s[k] for m in merged for s in m] for k in range(3)]

    made = map_columns(per_text, ["row", "removed"], [F.col("spans")], merge, "first long, last long, first_row long")
    return made.select("row", "first", "last", "first_row", "removed")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per repeated passage and document: ``key``, ``first_word``, ``last_word``, ``first_<key>``, ``removed``.

    Documents without a repeated passage have no row. The document with the smallest key keeps a passage, of those with
    one key the first in the table; NULL keys come last. Repeated rows are documents like others. Exact repeats inside
    one document are found too, edited ones are not. NULL, empty and short texts repeat nothing. An empty table gives an
    empty one.
    """
    numbered = numbered_by_key(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")), "_key", "_text")
    with freed(docs.sparkSession) as scratch:
        spans = scratch.keep(materialize(repeated_spans(numbered, "_text", **options), "spans"))
    names = numbered.select(F.col(ROW_TAG).alias("_row"), "_key")
    named = spans.join(names, F.col("row") == F.col("_row")).drop("_row").withColumnRenamed("_key", "own")
    named = named.join(names, F.col("first_row") == F.col("_row"))
    return named.select(
        F.col("own").alias(key),
        F.col("first").alias("first_word"),
        F.col("last").alias("last_word"),
        F.col("_key").alias(f"first_{key}"),
        "removed",
    )


def without_repeats(docs: DataFrame, text: str = "text", key: str | None = "doc_id", **options) -> DataFrame:
    """The documents with their own columns, repeated passages cut out of ``text``. Nothing else of a text changes.

    The document with the smallest ``key`` keeps a passage; with no ``key`` the first in the table does. NULL, empty and
    short texts stay as they are, and all rows stay, repeated ones too. Columns may have any names and types; their values
    never leave Arrow. An empty table gives an empty one.
    """
    names = without(docs, ROW_TAG).columns
    # own columns by place, so that no name clashes
    own = [f"_own_{i}" for i in range(len(names))]
    at = own[names.index(text)]
    renamed = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)])
    placed = numbered_by_key(renamed, own[names.index(key)] if key in names else None, at)
    listed = F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_spans_to_cut")
    with freed(docs.sparkSession) as scratch:
        spans = repeated_spans(placed, at, **options).where("removed")
        cuts = scratch.keep(materialize(spans.groupBy(F.col("row").alias("_at_row")).agg(listed), "cuts"))
    joined = placed.join(cuts, F.col(ROW_TAG) == F.col("_at_row"), "left")

    def cut(texts: list[str], spans: list) -> tuple:
        new = []
        for value, of_text in zip(texts, spans, strict=True):
            words, kept, end = [m.span() for m in FIND_WORDS.finditer(value)], [], 0
            for s in of_text:
                kept.append(value[end : words[s["first"]][0]])
                end = words[s["last"] - 1][1]
            new.append("".join([*kept, value[end:]]))
        return None, [new]

    kind = docs.select(F.col(f"`{text}`")).schema[0].dataType
    touched = joined.where("_spans_to_cut IS NOT NULL")
    changed = map_columns(touched, own, [F.col(at).cast("string"), F.col("_spans_to_cut")], cut, "_new string")
    changed = changed.select(*[F.col("_new").cast(kind).alias(at) if c == at else F.col(c) for c in own])
    return joined.where("_spans_to_cut IS NULL").select(*own).union(changed).toDF(*names)
