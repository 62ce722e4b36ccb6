"""Near-duplicate vectors by cosine, all against all in tiles.

Equal vectors are one class. Unit vectors are rounded to 8-bit numbers, and the length of every vector's rounding
error is kept: for u = q + e and v = r + f the product u.v differs from q.r by at most |e| |v| + |q| |f|. Tiles of
rounded vectors are multiplied, and only pairs that this bound leaves possible are computed in double precision.
A tile returns counts of links and a forest of them, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcast.llm.components import Forest, components
from spendcast.llm.text import map_columns, python_workers
from spendcast.session import materialize

# Vectors in a block: a tile of 4,096 by 4,096 products takes 64 MB.
BLOCK = 4_096
# Added to the bound: products of 8-bit numbers are exact, their scaling is not.
SLACK = 1e-6
# Candidates computed in double precision at a time.
AT_ONCE = 1 << 18


def unit(vector) -> np.ndarray | None:
    """The vector at length 1 in double precision; None for one without a direction."""
    if vector is None:
        return None
    try:
        v = np.asarray(vector, np.float64)
    except (TypeError, ValueError):
        return None
    if not len(v) or not np.isfinite(v).all() or not (largest := np.abs(v).max()):
        return None
    v = v / largest
    return v / np.sqrt(v @ v)


def classes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``row``, ``name``, ``same`` (digest of the values, NULL without a direction), ``size`` and ``unit``."""

    def describe(given: list) -> tuple:
        units = [unit(v) for v in given]
        same = [None if u is None else xxhash.xxh3_128_digest(u.tobytes()) for u in units]
        return None, [same, [0 if u is None else len(u) for u in units], [None if u is None else u.tobytes() for u in units]]

    named = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("name"), F.col(f"`{vector}`").alias("vector")
    )
    return map_columns(named, ["row", "name"], [F.col("vector")], describe, "same binary, dims int, unit binary")


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit numbers, their scale, the length of the rounded vector and of the error."""
    scale = np.abs(units).max(axis=1) / 127
    whole = np.rint(units / scale[:, None]).astype(np.int8)
    rounded = whole * scale[:, None]
    return whole, scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(units - rounded, axis=1)


def linked_pairs(a: np.ndarray, b: np.ndarray, least: float, same_block: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs with a cosine of ``least`` or more; within one block each pair once."""
    qa, sa, la, ea = quantised(a)
    qb, sb, _, eb = quantised(b)
    # products of 8-bit numbers stay below 2^24 up to a thousand dimensions, beyond that double precision is exact
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    found = [], []
    for start in range(0, len(a), 1024):
        part = slice(start, start + 1024)
        products = (qa[part].astype(kind) @ qb.T.astype(kind)) * sa[part, None] * sb
        possible = products + (ea[part, None] + la[part, None] * eb) >= least - SLACK
        if same_block:
            possible &= np.arange(len(b)) > np.arange(len(a))[part, None]
        i, j = np.nonzero(possible)
        for at in range(0, len(i), AT_ONCE):
            x, y = i[at : at + AT_ONCE] + start, j[at : at + AT_ONCE]
            near = np.einsum("ij,ij->i", a[x], b[y]) >= least
            found[0].append(x[near])
            found[1].append(y[near])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found[0]]), np.concatenate([empty, *found[1]])


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, block: int = BLOCK) -> DataFrame:
    """One row per vector: ``key``, ``n_links``, ``component_id``, ``kept``.

    Vectors link at a cosine of ``least`` or more. A vector that is NULL, empty, zero, or holds a NULL or non-finite
    component links with nothing, and vectors of different dimensions don't link. Repeated rows are vectors like
    others and link with each other. An empty table gives an empty one. All pairs of classes are compared, so the work
    grows with their square; it is spread over tiles, and a row is sent to as many tiles as there are blocks.
    """
    rows = materialize(classes(vectors, key, vector), "vectors")
    told = rows.where("same IS NOT NULL")
    grouped = told.groupBy("same", "dims").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("size"), F.min("name").alias("least_name"))
    grouped = materialize(grouped, "vector-classes")
    # blocks by hash: no order is needed, only an even size
    counts = grouped.groupBy("dims").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.col("dims").alias("_dims"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    in_block = grouped.join(counts, F.col("dims") == F.col("_dims")).select(
        "node", "size", "dims", "blocks", F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int").alias("block")
    )
    units = told.select(F.col("row").alias("node"), "unit")
    members = materialize(in_block.join(units, "node"), "vector-blocks")
    tile = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = members.select("*", tile).select(
        "dims",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        (F.col("block") > F.col("other")).alias("second"),
        "node",
        "size",
        "unit",
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a = rows[~rows["second"]]
        same = bool(rows["low"].iloc[0] == rows["high"].iloc[0])
        b = a if same else rows[rows["second"]]
        if a.empty or b.empty:
            return pd.DataFrame({"a": [], "b": [], "links": []}, dtype="int64")
        stack = lambda t: np.frombuffer(b"".join(t["unit"]), np.float64).reshape(len(t), -1)
        i, j = linked_pairs(stack(a), stack(b), least, same)
        node_a, node_b, size_a, size_b = (t[c].to_numpy() for c in ("node", "size") for t in (a, b))
        first = np.bincount(i, weights=size_b[j], minlength=len(a)).astype(np.int64)
        second = np.bincount(j, weights=size_a[i], minlength=len(b)).astype(np.int64)
        forest = Forest()
        pairs = [(x, y, 0) for x, y in zip(node_a[i].tolist(), node_b[j].tolist(), strict=True) if forest.join(x, y)]
        own = [(x, x, n) for x, n in [*zip(node_a.tolist(), first.tolist(), strict=True), *zip(node_b.tolist(), second.tolist(), strict=True)] if n]
        return pd.DataFrame(pairs + own, columns=["a", "b", "links"], dtype="int64")

    found = tiles.groupBy("dims", "low", "high").applyInPandas(compare, "a long, b long, links long")
    found = materialize(found, "vector-links")
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("a <> b").select("a", "b"))
    linked = grouped.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = linked.groupBy("root").agg(F.min("least_name").alias("component_id"))
    of_class = linked.join(smallest, "root").select(
        "same", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")
    )
    with_class = told.select("name", "same").join(of_class, "same").select("name", "n_links", "component_id")
    alone = rows.where("same IS NULL").select("name", F.lit(0).cast("long").alias("n_links"), F.col("name").alias("component_id"))
    return with_class.union(alone).select(
        F.col("name").alias(key), "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("name")).alias("kept")
    )
