"""Near-duplicate documents by bottom-k sketches.

One hash function orders all shingles. A set's sketch is its k smallest hashes, so two sets keep the same values of
what they share. Sets that are equal are one class from the start. Inverted lists of retained values bring similar
classes together, the sketch of the union estimates their similarity, and the full sets decide.

A value that many sketches retain (a passage that is found everywhere, or a large group of near copies) makes no
list of pairs. Classes that retain mostly such values are compared with a few hubs of each list. What is still
apart is compared as full sets, block by block, so that no pairs leave a task but the links of a forest; blocks of
one component are passed over. Other classes have enough further values to be found by those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcast.llm.components import Forest, components
from spendcast.llm.text import ROW_TAG, all_but, asked_for, let_go, map_columns, python_workers, steadily_tagged, word_hashes
from spendcast.operators.ordered import order_rows, running_sums
from spendcast.session import freed, materialize

# Values retained of each set, and the smallest of them that make lists.
RETAINED = 64
LOOKED_AT = 32
# A value retained by more classes makes no pairs by itself.
LONGEST_LIST = 32
# Values by which a class is listed. A pair at the threshold shares each with a chance of five in eight or more
# unless its classes are among the crowded ones, so it shares fewer than three once in some hundred thousand pairs
# (never counted where a class has fewer values).
LISTED = 16
LEAST_OVERLAP = 3
# Share of crowded values from which a class is compared through them.
CROWDED = 0.45
# Crowded values by which such a class is listed: a pair shares none of them once in a hundred thousand pairs.
LOUD = 6
# Hubs of each list, by rank, with which the others are compared before blocks of the list are compared as a whole.
HUBS = ((1, 1), (2, 5))
# Shingles in a block, each set counting for some more: at most 512 sets.
BLOCK = 1 << 18
# The estimate must reach the threshold less so many standard errors.
ERRORS = 4.0


def shingle_hashes(text: str | None, words_per_shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text with fewer words is one shingle, one without is empty."""
    # bytes know the same white space and letters A-Z as the task does
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    width = min(words_per_shingle, len(words))
    mixed = np.full(len(h) - width + 1, np.uint64(width * 0x9E3779B97F4A7C15 % 2**64))
    with np.errstate(over="ignore"):
        for i in range(width):
            mixed = (mixed ^ h[i : len(h) - width + 1 + i]) * np.uint64(0xFF51AFD7ED558CCD)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xC4CEB9FE1A85EC53)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def shingle_sets(
    docs: DataFrame, columns: list[str], text: str, words_per_shingle: int, sketch: int | None, as_array: bool = False
) -> DataFrame:
    """``columns``, ``n_shingles``, and either ``same`` (a 128-bit digest of the set) with ``sketch``, or the ``hashes``."""
    def sets(texts: list[str | None]) -> tuple:
        let_go()
        found = [shingle_hashes(t, words_per_shingle) for t in texts]
        sizes = [len(x) for x in found]
        if sketch is None:
            return None, [sizes, [x.view(np.int64) if as_array else x.tobytes() for x in found]]
        return None, [sizes, [xxhash.xxh3_128_digest(x.tobytes()) for x in found], [x[:sketch].view(np.int64) for x in found]]

    made = f"hashes {'array<long>' if as_array else 'binary'}" if sketch is None else "same binary, sketch array<long>"
    return map_columns(docs, columns, [F.col(f"`{text}`").cast("string")], sets, f"n_shingles long, {made}")


def similar(table: DataFrame, keys: list[str], decide, kind: str) -> DataFrame:
    """``keys`` of the rows whose columns ``left`` and ``right`` satisfy ``decide``, tested in Arrow batches."""
    python_workers(table.sparkSession)

    def values(column: pa.Array) -> Iterator:
        return (x.values.to_numpy() if pa.types.is_list(column.type) else x.as_py() for x in column)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            pairs = zip(values(batch.column("left")), values(batch.column("right")), strict=True)
            alike = pa.array([bool(decide(a, b)) for a, b in pairs], pa.bool_())
            yield batch.select(keys).filter(alike)

    return table.mapInArrow(test, kind)


class NearCopies:
    """Links between the classes of one table of documents. Every step is written once and read where it is needed."""

    def __init__(self, docs: DataFrame, key: str, text: str, percent: int, words_per_shingle: int):
        self.key, self.text, self.percent, self.width = key, text, percent, words_per_shingle
        rows = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
        # a key that is a row's steady number already numbers the rows
        numbered = rows.withColumn(ROW_TAG, F.col("doc")) if key == ROW_TAG else steadily_tagged(rows)
        numbered = numbered.withColumnRenamed(ROW_TAG, "row")
        self.rows = materialize(shingle_sets(numbered, ["row", "doc"], "text", words_per_shingle, RETAINED), "sketches")
        # the class of all rows with one set is named by its first row
        filled = self.rows.where("n_shingles > 0")
        grouped = filled.groupBy("same").agg(F.min("row").alias("node"), F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n"))
        self.classes = materialize(grouped, "classes")
        several = self.classes.where("n > 1").select("same", F.col("node").alias("first"))
        others = filled.select("same", F.col("row").alias("node")).join(several, "same").where("node <> first")
        # sketches of first rows, by far the most, stay where they are; only those of other rows are moved, to be left out
        sketches = filled.select(F.col("row").alias("node"), "n_shingles", "sketch")
        self.sketches = materialize(all_but(sketches, materialize(others.select("node"), "other-rows"), "node"), "class-sketches")
        self.numbered = numbered

    def listed(self) -> tuple[DataFrame, DataFrame]:
        """Inverted lists ``value, node, few``: of values in few sketches, and of crowded values in crowded sketches."""
        retained = self.sketches.select("node", F.posexplode(F.slice("sketch", 1, LOOKED_AT)).alias("at", "value"))
        crowd = retained.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        crowd = materialize(crowd, "crowd")
        # values in one sketch alone take part in no list, but count among the first of a class
        counted = retained.join(crowd, "value", "left").withColumn("crowded", F.coalesce(F.col("n") > LONGEST_LIST, F.lit(False)))
        entry = F.struct("at", "value", "crowded", F.coalesce("n", F.lit(1)).alias("n"))
        per_class = counted.groupBy("node").agg(F.array_sort(F.collect_list(entry)).alias("all"))  # LOOKED_AT at most
        split = per_class.select(
            "node",
            F.slice(F.filter("all", lambda e: ~e["crowded"]), 1, LISTED).alias("quiet"),
            F.slice(F.filter("all", lambda e: e["crowded"]), 1, LOUD).alias("loud"),
            (F.size(F.filter("all", lambda e: e["crowded"])) >= CROWDED * F.size("all")).alias("is_crowded"),
            F.aggregate("all", F.lit(0.0), lambda s, e: s + F.log(e["n"].cast("double"))).alias("typical"),
        )
        split = materialize(split, "lists")
        few = F.size("quiet") < LISTED
        quiet = split.select("node", few.alias("few"), F.explode("quiet").alias("e")).where("e.n > 1")
        loud = split.where("is_crowded").select("node", "typical", F.explode("loud").alias("e"))
        return quiet.select("e.value", "node", "few"), loud.select("e.value", "node", "typical")

    def shared_enough(self, nodes: DataFrame) -> DataFrame:
        """Of classes to be compared among themselves, those that share enough shingles with any other to have a link."""
        sets = shingle_sets(self.texts_of(nodes), ["node"], "text", self.width, None, as_array=True)
        self.crowded_sets = materialize(sets, "crowded-sets")
        each = self.crowded_sets.select("node", "n_shingles", F.explode("hashes").alias("h"))
        common = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
        shared = each.join(common, "h").groupBy("node").agg(F.count(F.lit(1)).alias("shared"), F.first("n_shingles").alias("n"))
        return shared.where(F.col("shared") * 100 >= self.percent * F.col("n")).select("node")

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        """``node`` and ``text`` of classes. All other texts stay where they are: they are far larger than what is asked for."""
        nodes = materialize(nodes, "asked-nodes")
        texts = self.numbered.select(F.col("row").alias("node"), "text")
        return asked_for(texts, "node", nodes, "node").join(nodes, "node", "left_semi")

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Of ``a, b``, those whose union sketch comes near the threshold and whose full sets reach it."""
        with freed(pairs.sparkSession) as scratch:
            return scratch.keep(self.compared(pairs))

    def compared(self, pairs: DataFrame) -> DataFrame:
        least = self.percent / 100
        percent = self.percent

        def near(left: np.ndarray, right: np.ndarray) -> bool:
            union = np.union1d(left.view(np.uint64), right.view(np.uint64))[:RETAINED]
            both = np.isin(union, left.view(np.uint64)) & np.isin(union, right.view(np.uint64))
            size = len(union)
            return both.mean() >= least - ERRORS * (least * (1 - least) / size) ** 0.5 if size == RETAINED else both.mean() >= least - 1e-9

        def reach(left: bytes, right: bytes) -> bool:
            left, right = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            shared = len(np.intersect1d(left, right, assume_unique=True))
            return 100 * shared >= percent * (len(left) + len(right) - shared)

        def side(table: DataFrame, key: str, value: str, name: str) -> DataFrame:
            size = F.col("n_shingles").alias(f"n_{name}")
            return table.select(F.col("node").alias(key), F.col(value).alias(name), size)

        pairs = materialize(pairs, "pairs")
        asked = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "asked-for")
        sketches = asked_for(self.sketches, "node", asked, "node").join(asked, "node", "left_semi")
        sketches = materialize(sketches, "asked-sketches")
        sketched = pairs.join(side(sketches, "a", "sketch", "left"), "a").join(side(sketches, "b", "sketch", "right"), "b")
        # sizes further apart than the threshold allows can't reach it
        fitting = sketched.where(100 * F.least("n_left", "n_right") >= percent * F.greatest("n_left", "n_right"))
        close = materialize(similar(fitting, ["a", "b"], near, "a long, b long"), "close")
        needed = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
        sets = materialize(shingle_sets(self.texts_of(needed), ["node"], "text", self.width, None), "sets")
        full = close.join(side(sets, "a", "hashes", "left"), "a").join(side(sets, "b", "hashes", "right"), "b")
        return materialize(similar(full, ["a", "b"], reach, "a long, b long"), "links")

    def links(self) -> DataFrame:
        """Links that connect whatever is connected; of links within one component, not all need be there."""
        quiet, loud = self.listed()
        other = quiet.select("value", F.col("node").alias("b"), F.col("few").alias("few_b"))
        pairs = quiet.select("value", F.col("node").alias("a"), F.col("few").alias("few_a")).join(other, "value").where("a < b")
        overlaps = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("few_a") | F.col("few_b")).alias("few"))
        links = self.alike(overlaps.where(f"n >= {LEAST_OVERLAP} OR few").select("a", "b"))

        loud = loud.join(self.shared_enough(loud.select("node").distinct()), "node")
        loud = loud.withColumns({"one": F.lit(1).cast("long"), "rarity": -F.col("typical")})
        # the class whose values are the most common is the nearest to all others, so hubs are taken from there
        ordered = order_rows(loud, ["value", "rarity", "node"])
        if ordered.isEmpty():
            return links
        ranked = running_sums(ordered, {"value": {"rank": "one"}}).select("value", "node", "rank")
        ranked = materialize(ranked, "ranked")
        for first, last in HUBS:
            at = with_roots(ranked, components(links))
            hubs = at.where((F.col("rank") >= first) & (F.col("rank") <= last))
            hubs = hubs.select("value", F.col("node").alias("a"), F.col("rank").alias("hub_rank"), F.col("root").alias("hub_root"))
            pairs = at.join(hubs, "value").where("rank > hub_rank AND root <> hub_root")
            links = links.union(self.alike(pairs.select("a", F.col("node").alias("b")).distinct()))
        return links.union(tiled(with_roots(ranked, components(links)), self.crowded_sets, self.percent))


def with_roots(listed: DataFrame, roots: DataFrame) -> DataFrame:
    named = roots.select(F.col("node").alias("_n"), "root")
    joined = listed.join(named, F.col("node") == F.col("_n"), "left")
    return joined.select("value", "node", "rank", F.coalesce("root", "node").alias("root"))


def tiled(listed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components within a list, found by comparing blocks of full sets.

    ``listed`` has ``value, node, root``, ``sets`` has ``node, n_shingles, hashes``. Lists lie in order of components, so
    most blocks hold one component and need no comparison with its others.
    """
    sizes = sets.select(F.col("node").alias("_n"), "n_shingles")
    sized = listed.join(sizes, F.col("node") == F.col("_n")).select("value", "root", "node", (F.col("n_shingles") + BLOCK // 512).alias("room"))
    summed = running_sums(order_rows(sized, ["value", "root", "node"]), {"value": {"up_to": "room"}})
    blocked = materialize(summed.select("value", "root", "node", F.floor(F.col("up_to") / BLOCK).alias("block")), "blocks")
    blocks = blocked.groupBy("value", "block").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    other = blocks.select("value", F.col("block").alias("block2"), F.col("least").alias("least2"), F.col("most").alias("most2"))
    tiles = blocks.join(other, "value").where("block <= block2 AND least(least, least2) < greatest(most, most2)")
    tiles = materialize(tiles.select("value", "block", "block2"), "tiles")
    left = tiles.select("value", "block", "block2", F.lit(0).alias("side"), F.col("block").alias("take"))
    right = tiles.where("block < block2").select("value", "block", "block2", F.lit(1).alias("side"), F.col("block2").alias("take"))
    members = blocked.withColumnRenamed("block", "take")
    placed = left.union(right).join(members, ["value", "take"])
    filled = placed.join(sets.select("node", "hashes"), "node")

    def compare(rows):
        import pandas as pd  # here alone, as it takes some 30 MB of every worker that loads it

        a = rows[rows["side"] == 0]
        b = rows[rows["side"] == 1] if (rows["side"] == 1).any() else a
        shared = shared_counts(a["hashes"].tolist(), b["hashes"].tolist())
        total = np.array([len(x) for x in a["hashes"]])[:, None] + np.array([len(x) for x in b["hashes"]])
        apart = a["root"].to_numpy()[:, None] != b["root"].to_numpy()
        i, j = np.nonzero((100 * shared >= percent * (total - shared)) & apart)
        forest, a_nodes, b_nodes = Forest(), a["node"].tolist(), b["node"].tolist()
        found = [(a_nodes[x], b_nodes[y]) for x, y in zip(i, j, strict=True) if forest.join(a_nodes[x], b_nodes[y])]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    python_workers(listed.sparkSession)
    grouped = filled.groupBy("value", "block", "block2").applyInPandas(compare, "a long, b long")
    return materialize(grouped, "tile-links")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8_192) -> np.ndarray:
    """How many values each set of one list shares with each of the other: products of 0/1 matrices, columns by columns."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
        there = common[at] == values if len(common) else np.zeros(len(values), bool)
        return np.repeat(np.arange(len(sets)), [len(x) for x in sets])[there], at[there]

    (i, x), (j, y) = places(left), places(right)
    for start in range(0, len(common), columns):
        one, two = np.zeros((len(left), columns), np.float32), np.zeros((len(right), columns), np.float32)
        use = (x >= start) & (x < start + columns)
        one[i[use], x[use] - start] = 1
        use = (y >= start) & (y < start + columns)
        two[j[use], y[use] - start] = 1
        out += one @ two.T
    return out.astype(np.int64)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, words_per_shingle: int = 3
) -> DataFrame:
    """One row per document: ``key``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 times the shared shingles reach ``percent`` times those of both; letters A-Z count
    as a-z. ``component_id`` is the smallest ``key`` reachable by links, ``kept`` says that it is the row's own. A NULL or
    empty text has no shingles and no links. Repeated rows are all kept or all not kept, as they share their key. An
    empty table gives an empty one.
    """
    with freed(docs.sparkSession) as scratch:
        found = NearCopies(docs, key, text, percent, words_per_shingle)
        # sketches and texts are done with once the roots are known
        rows = scratch.keep(materialize(found.rows.select("doc", "n_shingles", "same"), "sizes"))
        classes = scratch.keep(found.classes)
        roots = scratch.keep(materialize(components(found.links()), "roots"))
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    of_class = named.join(smallest, "root").select("same", "component_id")
    filled = rows.where("n_shingles > 0").join(of_class, "same")
    empty = rows.where("n_shingles = 0").select("doc", "n_shingles", F.col("doc").alias("component_id"))
    return filled.select(*empty.columns).union(empty).select(
        F.col("doc").alias(key), "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc")).alias("kept")
    )
