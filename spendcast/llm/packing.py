"""Packing pieces of documents into sequences by patterns.

A pattern says which lengths share a sequence. Patterns of two or three lengths that fill a sequence exactly are
enumerated, their repeat counts are fitted to the histogram of lengths by non-negative least squares and rounded
down, and what the rounding leaves is packed by best fit, again as patterns with counts. All this works on counts
per length, of which there are at most as many as a sequence has tokens; documents only take numbered places.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcast.llm.text import ROW_TAG, map_columns, tagged
from spendcast.llm.tokens import encoder
from spendcast.operators.ordered import order_rows, running_sums
from spendcast.session import materialize

MAX_TOKENS = 2048
# Of what the longest of three leaves, the share of the second: each gives one pattern per length.
SHARES = (0.5, 0.55, 0.62, 0.7, 0.8, 0.9)
SWEEPS = 40

# A pattern is a tuple of (length, how many), longest first; with it goes the number of sequences that repeat it.
Pattern = tuple[tuple[int, int], ...]


def pieces(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    max_tokens: int = MAX_TOKENS,
    end_id: int = 0,
    ids: bool = False,
) -> DataFrame:
    """``key``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids`` (little-endian 32-bit).

    A document's ids end with ``end_id``, which is all that a NULL or empty text has. Longer ones are cut into pieces of ``max_tokens``; the first takes the rest.
    """

    def cut(texts: list[str | None]) -> tuple:
        own = encoder(tokenizer, end_id)
        places, out = [], [[] for _ in range(5)]
        for place, all_ids in enumerate(own.encode_all(texts)):
            first = (len(all_ids) - 1) % max_tokens + 1
            edges = [0, *range(first, len(all_ids) + 1, max_tokens)]
            for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                raw = all_ids[a:b].astype("<u4").tobytes()
                places.append(place)
                for column, value in zip(out, (piece, a, b - a, zlib.crc32(raw), raw), strict=True):
                    column.append(value)
        return places, out if ids else out[:4]

    made = "piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    return map_columns(docs, [key], [F.col(f"`{text}`").cast("string")], cut, made)


def exact_patterns(lengths: Sequence[int], max_tokens: int) -> list[Pattern]:
    """Patterns of one to three of ``lengths`` that fill a sequence exactly."""
    there = set(lengths)
    found: dict[tuple[int, ...], None] = {}
    for a in sorted(there, reverse=True):
        rest = max_tokens - a
        if rest == 0:
            found[a,] = None
        if rest <= 0:
            continue
        for b, c in [(rest, 0)] + [(round(rest * s), rest - round(rest * s)) for s in SHARES]:
            if b in there and (c == 0 or c in there):
                found[tuple(sorted((a, b) if c == 0 else (a, b, c), reverse=True))] = None
    return [tuple((x, p.count(x)) for x in dict.fromkeys(p)) for p in found]


def fit_repeats(patterns: Sequence[Pattern], histogram: dict[int, int], sweeps: int = SWEEPS) -> list[float]:
    """Non-negative least squares: repeats whose summed patterns come nearest to the histogram.

    Coordinate descent: each repeat in turn takes its best value at or above 0 while the others rest. A pattern has
    three entries at most, so a sweep is linear in the patterns, and sweeps approach the least square.
    """
    residual = dict(histogram)
    repeats = [0.0] * len(patterns)
    norms = [sum(m * m for _, m in p) for p in patterns]
    for _ in range(sweeps):
        for j, p in enumerate(patterns):
            step = sum(m * residual[x] for x, m in p) / norms[j]
            new = max(0.0, repeats[j] + step)
            if new != repeats[j]:
                for x, m in p:
                    residual[x] -= m * (new - repeats[j])
                repeats[j] = new
    return repeats


def best_fit(histogram: dict[int, int], max_tokens: int) -> list[tuple[Pattern, int]]:
    """Best fit with falling lengths on counts: sequences alike are one pattern with a count."""
    open_by_gap: dict[int, list[tuple[Pattern, int]]] = {}
    gaps: list[int] = []
    done: list[tuple[Pattern, int]] = []

    def put(pattern: Pattern, count: int, gap: int) -> None:
        if not count:
            return
        if gap == 0:
            done.append((pattern, count))
            return
        if gap not in open_by_gap:
            open_by_gap[gap] = []
            insort(gaps, gap)
        open_by_gap[gap].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and (at := bisect_left(gaps, length)) < len(gaps):
            gap = gaps[at]
            pattern, count = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                del open_by_gap[gap], gaps[at]
            each = gap // length
            full, rest = min(count, left // each), 0
            if full < count:
                rest = left - full * each if full == left // each else 0
                rest = min(rest, each - 1)
            put((*pattern, (length, each)), full, gap - each * length)
            put((*pattern, (length, rest)) if rest else pattern, 1 if rest else 0, gap - rest * length)
            put(pattern, count - full - (1 if rest else 0), gap)
            left -= full * each + rest
            if not full and not rest:
                break
        each = max_tokens // length
        put(((length, each),), left // each, max_tokens - each * length)
        put(((length, left % each),), 1 if left % each else 0, max_tokens - left % each * length)
    return done + [x for group in open_by_gap.values() for x in group]


def plan(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[Pattern, int]]:
    """Patterns with counts that use up the histogram."""
    left = {x: n for x, n in histogram.items() if n > 0}
    patterns = exact_patterns(list(left), max_tokens)
    fitted = fit_repeats(patterns, {x: float(n) for x, n in left.items()})
    planned = []
    for j in sorted(range(len(patterns)), key=lambda j: -fitted[j]):
        count = min([int(fitted[j]), *(left[x] // m for x, m in patterns[j])])
        if count:
            planned.append((patterns[j], count))
            for x, m in patterns[j]:
                left[x] -= m * count
    return planned + best_fit({x: n for x, n in left.items() if n}, max_tokens)


def places(planned: Sequence[tuple[Pattern, int]]) -> pd.DataFrame:
    """One row per run of equal lengths in a pattern.

    Of the pieces of ``length``, those numbered from ``first`` on go there, ``many`` to a sequence: the sequences are
    ``sequence`` and following, and the run begins at ``offset``.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in planned:
        offset = 0
        for length, many in pattern:
            rows.append((length, used.get(length, 0), many, sequence, offset))
            used[length] = used.get(length, 0) + many * count
            offset += length * many
        sequence += count
    return pd.DataFrame(rows, columns=["length", "first", "many", "sequence", "offset"]).sort_values(["length", "first"])


def pack(cut: DataFrame, key: str = "doc_id", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Give every piece (``pieces``) its ``sequence_id`` and ``offset``; all columns of ``cut`` stay.

    Pieces of one length are numbered by chunked running counts in key order; repeated rows get places of their own.
    An empty table gives an empty one. The driver sees one count per length, at most ``max_tokens`` of them, and
    tasks get the places of the patterns, a few for each length.
    """
    ordered = order_rows(tagged(cut), ["length", key, "piece", ROW_TAG])
    histogram = {int(r.length): r["count"] for r in ordered.groupBy("length").count().collect()}
    layout = places(plan(histogram, max_tokens))
    # lengths are at most max_tokens, so length and number share one sorted key
    starts = (layout["length"].to_numpy(np.int64) << 48) + layout["first"].to_numpy(np.int64)
    table = {c: layout[c].to_numpy(np.int64) for c in ("first", "many", "sequence", "offset")}
    numbered = running_sums(ordered.withColumn("_one", F.lit(1).cast("long")), {"length": {"_number": "_one"}})

    def place(number: list[int], length: list[int]) -> tuple:
        number, length = np.array(number, np.int64) - 1, np.array(length, np.int64)
        row = np.searchsorted(starts, (length << 48) + number, side="right") - 1
        inside = number - table["first"][row]
        sequence = table["sequence"][row] + inside // table["many"][row]
        return None, [sequence, table["offset"][row] + inside % table["many"][row] * length]

    return map_columns(numbered, cut.columns, [F.col("_number"), F.col("length")], place, "sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, **options) -> DataFrame:
    """Cut every document and pack the pieces. The cut is written once: numbering would else encode twice."""
    key = options.get("key", "doc_id")
    return pack(materialize(pieces(docs, tokenizer, max_tokens=max_tokens, **options), "pieces"), key, max_tokens)
