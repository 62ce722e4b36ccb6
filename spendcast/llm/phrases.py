"""Collocations: contiguous phrases whose words meet more often than chance, counted in truncated suffix trees.

Every place of a text begins a suffix of at most ``most_words`` words; a phrase occurs as often as suffixes begin with
it. The tree of all suffixes is cut vertically into groups by word prefix. Prefixes are counted first: of one word, then
of two words that are both frequent. A prefix with more suffixes than a group may hold is extended by a word, and again,
until its parts fit. Only then are the suffixes dealt to groups, each cut where it stops being frequent. A group's
suffixes, in order, are the leaves of its subtree from left to right, so a phrase's count is the sum of a run of leaves.

Words are told apart by 64-bit hashes; two frequent words of one language with one hash are refused. Which words and
pairs are frequent is told to the tasks by bit fields of a fixed size. A field that fills up lets more suffixes
through, whose counts are then found to be too small; it never loses one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendcast.llm.text import CAPITALS, SMALL, map_columns, python_workers, whole, word_hashes
from spendcast.session import materialize

LEAST, MOST_WORDS, FIRST = 100, 5, 2000
# A phrase goes with a longer one that has so many percent of its occurrences.
COVERED = 100
# Suffixes in a group at most, 64 bytes each, and the fewest that are worth a group.
GROUP_MOST, GROUP_LEAST = 1 << 20, 1 << 16
# Bytes of text whose suffixes are cut at a time.
AT_ONCE = 1 << 19
# Bits of a field: 8 MB, whatever the vocabulary.
FIELD_BITS = 26
UNKNOWN = "und"
# What ends a piece. "!" stands for all of them, so it is no word.
ENDS = b".,;:!?\n\x0b\x0c\r"
PIECES = bytes.maketrans(ENDS + CAPITALS, b"!" * len(ENDS) + SMALL)
BREAK = b"!"


def flat_words(texts: Sequence[bytes]) -> list[bytes]:
    """The words of many texts in a row, with a break between pieces."""
    return b"!".join(texts).translate(PIECES).replace(BREAK, b" ! ").split()


def by_language(texts: Sequence[bytes], langs: Sequence[str], at_once: int | None = None) -> Iterator[tuple[str, list[bytes]]]:
    """The words of the texts of each language; of whole texts of about ``at_once`` bytes at a time, or of all."""
    sorted_out: dict[str, list[bytes]] = {}
    for text, lang in zip(texts, langs, strict=True):
        sorted_out.setdefault(lang, []).append(text)
    for lang, own in sorted_out.items():
        part = np.cumsum([len(t) for t in own]) // (at_once or sum(map(len, own)) + 1)
        for some in np.split(np.arange(len(own)), np.flatnonzero(np.diff(part)) + 1):
            yield lang, flat_words(own[some[0] : some[-1] + 1])


def chained(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The key of a prefix with one word more."""
    with np.errstate(over="ignore"):
        key = (key ^ symbol) * np.uint64(0xD6E8FEB86659FD93)
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
        return key ^ (key >> np.uint64(29))


class Field:
    """A set of keys as a bit field: two bits for a key, none of them missing for a member."""

    def __init__(self, keys: DataFrame, column: str = "key"):
        places = F.explode(F.array(*[F.shiftrightunsigned(column, s).bitwiseAND((1 << FIELD_BITS) - 1) for s in (0, 32)]))
        bits = keys.select(places.alias("bit")).select(
            F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, CAST(bit & 63 AS INT))").alias("mask")
        )
        # at most one row per 64 bits of the field
        rows = bits.groupBy("at").agg(F.bit_or("mask").alias("mask")).toPandas()
        words = np.zeros(1 << (FIELD_BITS - 6), np.int64)
        words[rows["at"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64)
        self.words = words.view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for shift in (0, 32):
            bit = (keys >> np.uint64(shift)) & np.uint64((1 << FIELD_BITS) - 1)
            out &= (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


class Phrases:
    """Frequent words and phrases of one table of texts."""

    def __init__(
        self, docs: DataFrame, text: str, lang: str, least: int, group_most: int = GROUP_MOST, group_least: int = GROUP_LEAST
    ):
        self.docs, self.least = docs, least
        self.group_most, self.group_least = group_most, group_least
        self.inputs = [whole(f"`{text}`").cast("binary"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN))]

    def scan(self, work, made: str) -> DataFrame:
        return map_columns(self.docs, [], self.inputs, work, made)

    def words(self) -> tuple[DataFrame, DataFrame]:
        """``lang_key, lang, n`` of every language, and ``lang_key, symbol, key, word, f`` of its frequent words."""
        def count(texts: list[bytes], langs: list[str]) -> tuple:
            out = [[] for _ in range(6)]
            for lang, words in by_language(texts, langs):
                counts = Counter(words)
                counts.pop(BREAK, None)
                symbols = word_hashes(counts)
                own = language_key(lang)
                out[0] += [lang] * len(counts)
                out[1] += [own] * len(counts)
                out[2] += signed(symbols).tolist()
                out[3] += signed(prefix_keys(own, symbols)).tolist()
                out[4] += counts.keys()
                out[5] += counts.values()
            return None, out

        counted = self.scan(count, "lang string, lang_key long, symbol long, key long, word binary, f long")
        counted = counted.groupBy("lang", "lang_key", "symbol", "key").agg(
            F.sum("f").alias("f"), F.min("word").alias("word"), F.max("word").alias("other")
        )
        counted = materialize(counted, "phrase-words")
        languages = materialize(counted.groupBy("lang", "lang_key").agg(F.sum("f").alias("n")), "phrase-languages")
        frequent = counted.where(F.col("f") >= self.least).drop("lang")
        if not frequent.where("word <> other").isEmpty():
            raise RuntimeError("two frequent words of one language have one 64-bit hash")
        return languages, frequent.drop("other")

    def count_prefixes(self, frequent: Sent, hot: np.ndarray | None) -> DataFrame:
        """``depth, key, f`` of prefixes of two frequent words, or of three and four words under ``hot`` ones of two."""
        def count(texts: list[bytes], langs: list[str]) -> tuple:
            depths, found, counts = [], [], []
            for lang, words in by_language(texts, langs):
                a, key, link = linked(words, lang, frequent)
                at = np.flatnonzero(link)
                key = chained(key[at], a[at + 1])
                for depth in (2,) if hot is None else (3, 4):
                    if depth > 2:
                        go = (np.isin(key, hot) if depth == 3 else True) & (at + depth - 1 < len(a))
                        at, key = at[go], key[go]
                        go = link[at + depth - 2]
                        at, key = at[go], key[go]
                        key = chained(key, a[at + depth - 1])
                    own, n = np.unique(key, return_counts=True)
                    depths.append(np.full(len(own), depth))
                    found.append(signed(own))
                    counts.append(n)
            nothing = np.zeros(0, np.int64)
            return None, [np.concatenate([nothing, *x]) for x in (depths, found, counts)]

        rows = self.scan(count, "depth int, key long, f long")
        return rows.groupBy("depth", "key").agg(F.sum("f").alias("f"))

    def leaves(self, frequent: Sent, pairs: Sent, hot: dict[int, np.ndarray], groups: int) -> DataFrame:
        """Suffixes of frequent pairs, ``group`` by group of a batch, packed as 64-bit numbers, equal ones once.

        A leaf is its language's key, the symbols (0 after the end), the owner, and how often it occurs. The owner is the
        number of words of the prefix that the group is chosen by; a shorter prefix has leaves in more groups.
        """
        def cut(texts: list[bytes], langs: list[str]) -> tuple:
            out = []
            for lang, words in by_language(texts, langs, AT_ONCE):
                a, key, link = linked(words, lang, frequent)
                first = np.flatnonzero(link)
                good = pairs.has(chained(key[first], a[first + 1]))
                link = np.zeros(len(a) + MOST_WORDS, bool)
                link[first[good]] = True
                a = np.concatenate([a, np.zeros(MOST_WORDS, np.uint64)])
                at = first[good]
                symbols = np.zeros((len(at), MOST_WORDS), np.uint64)
                symbols[:, 0] = a[at]
                chain, goes = key[at], np.ones(len(at), bool)
                group, owner = np.zeros(len(at), np.uint64), np.full(len(at), 2)
                full = key[at]
                for depth in range(2, MOST_WORDS + 1):
                    goes = goes & link[at + depth - 2]
                    symbols[goes, depth - 1] = a[at[goes] + depth - 1]
                    chain = np.where(goes, chained(chain, symbols[:, depth - 1]), chain)
                    full = chained(full, symbols[:, depth - 1])
                    group = np.where(goes & (owner == depth), chain, group)
                    if depth < MOST_WORDS:
                        owner = np.where(goes & (owner == depth) & np.isin(chain, hot[depth]), depth + 1, owner)
                _, one, n = np.unique(full, return_index=True, return_counts=True)
                spread = (group[one] % np.uint64(groups)).astype(np.int64)
                out.append((spread, np.full(len(one), language_key(lang)), signed(np.ascontiguousarray(symbols[one])), owner[one], n))
            if not out:
                return None, [[], []]
            group, *leaves = (np.concatenate(x) for x in zip(*out, strict=True))
            if not len(group):
                return None, [[], []]
            order = np.argsort(group, kind="stable")
            group, packed = group[order], np.concatenate([x.reshape(len(group), -1) for x in leaves], axis=1)[order]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            return None, [group[first], [x.tobytes() for x in np.split(packed, first[1:])]]

        return self.scan(cut, "group int, leaves binary")

    def nodes(self, leaves: DataFrame, groups: int) -> DataFrame:
        """``lang_key``, ``phrase`` (its symbols) and ``f`` of every frequent phrase of two words or more."""
        least, width, at_once = self.least, MOST_WORDS + 3, self.group_most
        python_workers(leaves.sparkSession)

        def collapsed(parts: list[np.ndarray]) -> np.ndarray:
            """Leaves from left to right, equal ones as one."""
            rows = np.concatenate(parts)
            parts.clear()
            rows = rows[np.lexsort(rows[:, MOST_WORDS::-1].T)]
            first = np.flatnonzero(np.append(True, (rows[1:, : MOST_WORDS + 1] != rows[:-1, : MOST_WORDS + 1]).any(axis=1)))
            sums = np.add.reduceat(rows[:, -1], first)
            rows = rows[first]
            rows[:, -1] = sums
            return rows

        def subtree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, size, room = [], 0, at_once
            for batch in batches:
                for packed in batch.column(0).to_pylist():
                    parts.append(np.frombuffer(packed, np.int64).reshape(-1, width))
                    size += len(parts[-1])
                    if size > room:  # equal leaves of many batches
                        parts = [collapsed(parts)]
                        size = len(parts[0])
                        room = max(at_once, 2 * size)
            if not size:
                return
            rows = collapsed(parts)
            turn = np.append(True, rows[1:, 0] != rows[:-1, 0])
            turn |= np.append(True, rows[1:, 1] != rows[:-1, 1])
            for depth in range(2, MOST_WORDS + 1):
                turn = turn | np.append(True, rows[1:, depth] != rows[:-1, depth])
                runs = np.flatnonzero(turn)
                sums = np.add.reduceat(rows[:, -1], runs)
                # a node above its owner's length has leaves in other groups too
                use = ((sums >= least) | (rows[runs, -2] > depth)) & (rows[runs, depth] != 0)
                runs, sums = runs[use], sums[use]
                phrase = pa.array(list(rows[runs, 1 : depth + 1]), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(rows[runs, 0]), phrase, pa.array(sums)], ["lang_key", "phrase", "f"])

        parts = leaves.repartitionById(groups, "group").select("leaves").mapInArrow(subtree, "lang_key long, phrase array<long>, f long")
        return parts.groupBy("lang_key", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)

    def mined(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Languages, frequent words, and frequent phrases."""
        languages, words = self.words()
        frequent = Field(words)
        sent = self.docs.sparkSession.sparkContext.broadcast
        frequent = Sent(sent(frequent))
        pairs = materialize(self.count_prefixes(frequent, None).where(F.col("f") >= self.least), "phrase-pairs")
        total = pairs.agg(F.sum("f")).first()[0] or 0
        partitions = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        budget = min(self.group_most, max(self.group_least, -(-total // partitions)))
        groups = max(1, -(-total // budget))
        # there are fewer hot prefixes of any length than groups
        hot = {d: np.zeros(0, np.uint64) for d in range(2, MOST_WORDS)}
        hot[2] = hot_keys(pairs, 2, budget)
        if len(hot[2]):
            longer = self.count_prefixes(frequent, hot[2]).where(F.col("f") > budget)
            longer = materialize(longer, "phrase-prefixes")
            hot |= {d: hot_keys(longer, d, budget) for d in (3, 4)}
        found = self.leaves(frequent, Sent(sent(Field(pairs))), hot, groups)
        return languages, words, materialize(self.nodes(found, groups), "phrases")


class Sent:
    """A field that every worker holds once."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.broadcast.value.has(keys)


def hot_keys(prefixes: DataFrame, depth: int, budget: int) -> np.ndarray:
    rows = prefixes.where((F.col("depth") == depth) & (F.col("f") > budget)).select("key").collect()
    return np.array([r["key"] for r in rows], np.int64).view(np.uint64)


def language_key(lang: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(lang.encode())).view(np.int64))


def prefix_keys(lang_key: int, symbols: np.ndarray) -> np.ndarray:
    """The keys of prefixes of one word."""
    return chained(np.full(len(symbols), lang_key, np.int64).view(np.uint64), symbols)


def linked(words: list[bytes], lang: str, frequent) -> tuple:
    """Symbols of words in a row, the key of each as a prefix of one word, and whether it and the next are frequent."""
    a = word_hashes(words)
    key = prefix_keys(language_key(lang), a)
    good = frequent.has(key) & (a != word_hashes([BREAK])[0])
    link = np.append(good[:-1] & good[1:], np.zeros(min(len(a), 1), bool))
    return a, key, link


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    first: int = FIRST,
    covered: int = COVERED,
    **groups,
) -> DataFrame:
    """The ``first`` phrases of two to five words of every language: ``lang, rank, phrase, a, l, r, n, score``.

    Letters A-Z count as a-z; a piece ends at ``.,;:!?`` or a line's end, and no phrase reaches over it. ``a`` counts all
    occurrences of the phrase, overlapping ones too; candidates have ``least``. Cut after its first words, with counts ``l``
    and ``r`` of the parts, a phrase scores ``floor(1000 * a * n / (l * r))`` for ``n`` words of the language; its lowest
    cut counts, the earliest on a tie. A phrase inside a longer one that has ``covered`` percent of its occurrences is
    left out. Ties in rank go by ``a``, then by the phrase's bytes. A NULL language is ``und``; NULL and empty texts have
    no words; a language without words or candidates has no rows, nor has an empty table. Repeated rows count as often
    as they occur. Other columns, whatever their names, are not read.
    """
    languages, words, phrases = Phrases(docs, text, lang, least, **groups).mined()
    parts = words.select("lang_key", F.array("symbol").alias("phrase"), "f").unionByName(phrases)
    cuts = phrases.select(
        "lang_key", F.col("phrase").alias("whole"), F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(phrase) - 1)")).alias("k")
    )
    side = [parts.select("lang_key", F.col("phrase").alias(side), F.col("f").alias(c)) for side, c in (("left", "l"), ("right", "r"))]
    cuts = cuts.withColumns({"left": F.expr("slice(whole, 1, k)"), "right": F.expr("slice(whole, k + 1, size(whole) - k)")})
    cuts = cuts.join(side[0], ["lang_key", "left"]).join(side[1], ["lang_key", "right"]).join(languages, "lang_key")
    # up to 10^38: a and l, r below 10^18, n below 10^15
    top = F.expr("CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(18,0)) * CAST(n AS DECIMAL(15,0))")
    scored = cuts.withColumn("top", top).withColumn("score", F.expr("CAST(top div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0))) AS BIGINT)"))
    lowest = scored.groupBy("lang_key", "lang", "whole", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = phrases.where(F.size("phrase") > 2).select(
        "lang_key",
        F.col("f").alias("longer"),
        F.explode(
            F.expr(
                "flatten(transform(sequence(2, size(phrase) - 1), w -> transform(sequence(1, size(phrase) - w + 1), i -> slice(phrase, i, w))))"
            )
        ).alias("whole"),
    )
    inside = inside.groupBy("lang_key", "whole").agg(F.max("longer").alias("longer"))
    free = lowest.join(inside, ["lang_key", "whole"], "left").where(f"longer IS NULL OR 100 * longer < {covered} * a")
    spelt = free.select("lang_key", "whole", F.posexplode("whole").alias("at", "symbol")).join(words.select("lang_key", "symbol", "word"), ["lang_key", "symbol"])
    spelt = spelt.groupBy("lang_key", "whole").agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("w"))
    named = free.join(spelt.select("lang_key", "whole", F.concat_ws(" ", "w.word").alias("phrase")), ["lang_key", "whole"])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    named = named.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    # the first of each part of a language are all that can be its first
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = named.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    of_part = Window.partitionBy("lang", "part").orderBy(F.desc("score"), F.desc("a"), "phrase")
    few = dealt.withColumn("place", F.row_number().over(of_part)).where(F.col("place") <= first)
    ranked = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
