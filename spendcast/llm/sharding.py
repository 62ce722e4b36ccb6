"""Rendezvous hashing: every key ranks all shards by a hash of its own and goes to the first.

A shard's place in a key's ranking depends on that key and shard alone. A new shard therefore takes over
only the keys that rank it first, and no key moves between two old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcast.llm.text import ROW_TAG, tagged, whole
from spendcast.operators.ordered import order_rows, running_sums

# 13 hexadecimal digits are 52 bits: exact in a double.
DIGITS = 13


def draw(key: Column, shard: int) -> Column:
    """A number above 0 and below 1 made from key and shard."""
    digest = F.md5(F.concat(key, F.lit(f"/{shard}")))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(16.0**DIGITS)


def score(key: Column, shard: int, weight: float) -> Column:
    """Smallest wins: exponential waiting times with rate ``weight`` give each shard its share."""
    return F.struct((-F.log(draw(key, shard)) / F.lit(float(weight))).alias("wait"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among ``len(weights)`` shards. A NULL key counts as an empty one.

    Equal waits go to the lower shard. Weights must be above 0.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    key = F.coalesce(key.cast("string"), F.lit(""))
    scores = [score(key, j, w) for j, w in enumerate(weights)]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard_documents(
    docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", weights: Sequence[float] | None = None
) -> DataFrame:
    """One row per document: ``key``, ``size`` (UTF-8 bytes and 8), ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``slot`` numbers the rows of a shard from 0 in key order without gaps, ``grown_shard`` is the shard with one
    more shard of weight 1. A NULL text has no bytes. Repeated rows and rows of one key share a shard and get a slot
    each, so ``slot`` of such rows may be swapped. An empty table gives an empty one; other columns are left out.
    Slots come from chunked running counts: no shard is ever gathered in one task.
    """
    weights = list(weights or [1.0] * shards)
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = tagged(docs.select(key, text)).select(
        key,
        (F.octet_length(whole(text)) + 8).cast("long").alias("size"),
        F.crc32(whole(text).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(name, weights).alias("shard"),
        rendezvous(name, [*weights, 1.0]).alias("grown_shard"),
        F.lit(1).cast("long").alias("one"),
        ROW_TAG,
    )
    ordered = order_rows(rows, ["shard", key, "text_crc32", "size", ROW_TAG])
    return running_sums(ordered, {"shard": {"rank": "one"}}).select(
        key, "size", "text_crc32", "law", "shard", (F.col("rank") - 1).alias("slot"), "grown_shard"
    )
