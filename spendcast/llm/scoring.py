"""Scoring texts by prediction by partial matching (PPM), with a word unigram beside it.

A text is the bytes of its words, A-Z lower, one space between words, and an end byte. The model is the trie of byte
contexts of the training texts: of each context up to the order, which bytes follow how often. A byte is coded in
the longest context known. Where the byte is new to a context, an escape is coded (method D: half a count from each
different follower goes to it), and the next shorter context leaves out the followers just refused. After the shortest
context the bytes left are alike.

All of this depends only on the longest context and the byte. So the counts of all such pairs are gathered, each
pair's code length is worked out once, and a text is scored by looking its pairs up. Tables are handed to tasks in
blocks of a stated number of entries; a larger table takes more passes over the texts, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcast.llm.text import ROW_TAG, map_texts, python_workers, steadily_tagged, word_hashes
from spendcast.session import materialize

# No word holds it: the end of a text, and what stands before its start.
END = b"\n"
# Longest context in bytes. With its byte, a pair fits six bytes of a number.
ORDER = 5
BYTE = np.uint64(8)
# Entries of a table that are handed to tasks at a time: 48 MB of keys and values.
BLOCK = 3 << 20
# Pairs counted, and bytes scored, at a time.
COUNTED_AT_ONCE = 1_000_000
SCORED_AT_ONCE = 400_000


def held_out(key: str) -> Column:
    """Documents that the model doesn't learn from."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens(text: str | None) -> list[bytes]:
    """Words in UTF-8; bytes know the same white space and letters A-Z as the task does."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def pairs(words: list[bytes]) -> np.ndarray:
    """Context and byte of every byte of a text, as numbers of six bytes."""
    raw = END * ORDER + b" ".join(words) + END
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = len(b) - ORDER
    out = np.zeros(n, np.uint64)
    for i in range(ORDER + 1):
        out = (out << BYTE) | b[i : i + n]
    return out


class Counts:
    """Sorted keys and their counts; new keys wait until there are enough to be sorted and merged."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: dict[int, list[np.ndarray]] = {0: [], 1: []}
        self.size = 0

    def add(self, keys: np.ndarray, weight: int) -> None:
        self.waiting[weight].append(keys)
        self.size += len(keys)
        if self.size > COUNTED_AT_ONCE + len(self.keys):
            self.merge()

    def merge(self) -> None:
        keys, counts = [self.keys], [self.counts]
        for weight, waiting in self.waiting.items():
            flat = np.sort(np.concatenate([np.zeros(0, np.uint64), *waiting]))
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
            keys.append(flat[first])
            counts.append(np.diff(np.append(first, len(flat))) * weight)
        self.keys, place = np.unique(np.concatenate(keys), return_inverse=True)
        self.counts = np.bincount(place, weights=np.concatenate(counts), minlength=len(self.keys)).astype(np.int64)
        self.waiting, self.size = {0: [], 1: []}, 0


def gathered(docs: DataFrame) -> DataFrame:
    """``kind`` (word or pair), ``key``, ``n`` in training texts; pairs of other texts have 0. One row per key and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {"word": Counts(), "pair": Counts()}
        for batch in batches:
            for text, held in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = tokens(text)
                seen["pair"].add(pairs(words), 0 if held else 1)
                if not held:
                    seen["word"].add(word_hashes([*words, END]), 1)
        for kind, counts in seen.items():
            counts.merge()
            for start in range(0, len(counts.keys), 100_000):
                keys, n = (x[start : start + 100_000] for x in (counts.keys.view(np.int64), counts.counts))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(n)), pa.array(keys), pa.array(n)], names=["kind", "key", "n"])

    found = docs.select("text", "held_out").mapInArrow(count, "kind string, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Level:
    """Followers of the contexts of one length, and each context's total, number of followers and what these
    take of the next shorter context."""

    def __init__(self, length: int, keys: np.ndarray, counts: np.ndarray, shorter: Level | None):
        self.mask = np.uint64((1 << (8 * (length + 1))) - 1)
        self.keys, self.counts = keys, counts
        self.contexts, place = np.unique(keys >> BYTE, return_inverse=True)
        sums = lambda w: np.bincount(place, weights=w, minlength=len(self.contexts))
        self.total, self.followers = sums(counts), sums(np.ones(len(counts)))
        self.taken = sums(shorter.count(keys)) if shorter else np.zeros(len(self.contexts))

    def count(self, keys: np.ndarray) -> np.ndarray:
        keys = keys & self.mask
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)

    def context(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        contexts = (keys & self.mask) >> BYTE
        if not len(self.contexts):
            return (np.zeros(len(keys)),) * 3
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        there = self.contexts[at] == contexts
        return tuple(np.where(there, x[at], 0.0) for x in (self.total, self.followers, self.taken))


def shortened(keys: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts for contexts of ``length`` bytes."""
    short, place = np.unique(keys & np.uint64((1 << (8 * (length + 1))) - 1), return_inverse=True)
    return short, np.bincount(place, weights=counts, minlength=len(short)).astype(np.int64)


def levels(keys: np.ndarray, counts: np.ndarray, longest: int, shortest: int, shorter: list[Level]) -> list[Level]:
    """Levels from the empty context on: ``shorter`` ones as given, the others from counts of the longest."""
    built = list(shorter)
    for length in range(shortest, longest + 1):
        built.append(Level(length, *shortened(keys, counts, length), built[-1] if built else None))
    return built


def log_probabilities(keys: np.ndarray, trie: list[Level]) -> np.ndarray:
    """log10 probability of each pair's byte after its context."""
    score = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)
    refused, taken = np.zeros(len(keys)), np.zeros(len(keys))
    for level in reversed(trie):
        total, followers, taken_below = level.context(keys)
        count = level.count(keys)
        # what the longer context refused is not offered again
        fresh = followers - refused
        room = total - taken
        offered = open_ & (total > 0) & (room > 0)
        hit = offered & (count > 0)
        score[hit] += np.log10((count[hit] - 0.5) / room[hit])
        escape = offered & (count == 0) & (fresh > 0)
        score[escape] += np.log10(0.5 * fresh[escape] / room[escape])
        open_ &= ~hit
        known = total > 0
        refused, taken = np.where(known, followers, 0.0), np.where(known, taken_below, 0.0)
    score[open_] -= np.log10(256 - refused[open_])
    return score


def pair_scores(found: DataFrame) -> DataFrame:
    """``key`` and ``value``, the log10 probability, of every pair gathered.

    Pairs are dealt by the last two bytes of their context, so all longer contexts of a pair meet in its task. The
    two shortest levels are the same for all: at most 65,792 counts.
    """
    trained = found.where("n > 0")
    first = trained.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n"))
    keys, counts = columns(first, "key", "n")
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    low = levels(keys[order], counts[order], 1, 0, [])

    def work_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        keys, n = (np.concatenate([p[i] for p in parts]) for i in range(2))
        trie = levels(keys[n > 0], n[n > 0], ORDER, 2, low)
        for start in range(0, len(keys), 200_000):
            part = keys[start : start + 200_000]
            found = (part.view(np.int64), log_probabilities(part, trie))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["key", "value"])

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartition(parts, F.shiftright("key", 8).bitwiseAND(0xFFFF))
    return dealt.select("key", "n").mapInArrow(work_out, "key long, value double")


def columns(table: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a bounded table, by Arrow: rows as Python objects would take thirty times the room."""
    arrow = table.select(*names).toArrow()
    return [arrow.column(n).to_numpy() for n in names]


def blocks(table: DataFrame, size: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and values of ``table`` (``key``, ``value``), about ``block`` entries at a time."""
    count = max(1, -(-size // block))
    for i in range(count):
        keys, values = columns(table.where(F.pmod(F.xxhash64("key"), F.lit(count)) == i), "key", "value")
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        yield keys[order], values[order].astype(np.float64)


def summed(keys: list[np.ndarray], table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per list of keys, the values found and their number. Keys are looked up in order, which keeps to near memory."""
    if not len(table[0]):
        return np.zeros(len(keys)), np.zeros(len(keys))
    sizes = [len(k) for k in keys]
    flat = np.concatenate(keys)
    order = np.argsort(flat)
    asked = flat[order]
    names, values = table
    at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
    there = names[at] == asked
    found, hits = np.zeros(len(flat)), np.zeros(len(flat))
    found[order[there]] = values[at[there]]
    hits[order] = there
    ends = np.cumsum(sizes)
    both = [np.concatenate([[0.0], np.cumsum(x)]) for x in (found, hits)]
    starts = ends - sizes
    # each text is summed by itself: differences of long running sums would lose digits
    total = np.array([found[a:b].sum() for a, b in zip(starts, ends, strict=True)])
    return total, both[1][ends] - both[1][starts]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: ``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Training texts are those whose ``crc32(key as text) mod 10`` is not 0. A NULL text is an empty one: an end alone.
    Repeated rows count and are scored each by itself. An empty table, or one without training texts, has no counts:
    every byte then has probability 1/256.
    """
    spark = docs.sparkSession
    python_workers(spark)
    numbered = steadily_tagged(docs.select(key, text)).select(
        F.col(ROW_TAG).alias("row"),
        F.col(f"`{key}`").alias("name"),
        F.col(f"`{text}`").cast("string").alias("text"),
        held_out(key).alias("held_out"),
    )
    found = materialize(gathered(numbered), "counts")
    words = found.where("kind = 'word'").select("key", F.col("n").alias("value"))
    train = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("value"), F.lit(0)).alias("n")).first()
    chances = materialize(pair_scores(found.where("kind = 'pair'")), "pair-scores")
    n_pairs = chances.count()

    passes, nothing = [], (np.zeros(0, np.uint64), np.zeros(0))
    word_blocks, pair_blocks = blocks(words, train.v, block), blocks(chances, n_pairs, block)
    for number in range(max(1, -(-train.v // block), -(-n_pairs // block))):
        (names, counts), of_pairs = next(word_blocks, nothing), next(pair_blocks, nothing)
        handed = spark.sparkContext.broadcast(((names, np.log10(counts + 0.1)), of_pairs))

        def look_up(texts: list[bytes], handed=handed) -> tuple:
            logs, of_pairs = handed.value
            found: list[tuple] = []
            until = np.cumsum([len(t) + 1 for t in texts]) // SCORED_AT_ONCE
            for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(until)) + 1) if texts else ():
                part = [texts[i].lower().split() for i in some]
                base, hits = summed([word_hashes([*t, END]) if len(logs[0]) else () for t in part], logs)
                exact, _ = summed([pairs(t) if len(of_pairs[0]) else () for t in part], of_pairs)
                found.append((np.array([len(t) + 1 for t in part], np.int64), hits.astype(np.int64), base, exact))
            return None, [np.concatenate(x) for x in zip(*found, strict=True)] if found else [[]] * 4

        scored = map_texts(numbered, ["row"], "text", look_up, "n_tokens long, hits long, base double, exact double")
        passes.append(materialize(scored, f"scores-{number}"))
    parts = passes[0]
    for more in passes[1:]:
        parts = parts.union(more)
    total = parts.groupBy("row").agg(
        F.max("n_tokens").alias("n_tokens"), F.sum("hits").alias("n_known"), F.sum("base").alias("base"), F.sum("exact").alias("score")
    )
    rest = float(np.log10(train.n + 0.1 * (train.v + 1)))
    base = F.col("base") - (F.col("n_tokens") - F.col("n_known")) - F.col("n_tokens") * F.lit(rest)
    return numbered.select("row", "name", "held_out").join(total, "row").select(
        F.col("name").alias(key), "held_out", "n_tokens", "n_known", F.lit(int(train.n)).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score",
    )
