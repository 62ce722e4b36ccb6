"""Connected components of a table of links, by local merging and alternating stars.

Every round first merges what meets in one task (a forest of the task's links, never more rows than it read), then
points neighbours to the smallest one they know, upward and downward in turn. Rounds end when every node hangs from
a root. Links, roots and nodes stay in tables; each round's result is written, which cuts its lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcast.llm.text import let_go, python_workers
from spendcast.session import materialize


class Forest:
    """Disjoint sets whose root is the smallest member."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


def merge_locally(links: DataFrame) -> DataFrame:
    """``child`` and a smaller ``parent``: the forest of each task's links."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
        # a node that joined another is never a root again
        children = list(forest.parent)
        parents = [forest.root(x) for x in children]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (children, parents)], names=["child", "parent"])

    python_workers(links.sparkSession)
    return links.select("child", "parent").mapInArrow(merge, "child long, parent long")


def point_down(links: DataFrame) -> DataFrame:
    """Every child takes its smallest parent, and its other parents do so as well."""
    least = links.groupBy("child").agg(F.min("parent").alias("least"))
    both = links.join(least, "child")
    return least.select("child", F.col("least").alias("parent")).union(
        both.where("parent > least").select(F.col("parent").alias("child"), F.col("least").alias("parent"))
    )


def point_up(links: DataFrame) -> DataFrame:
    """Of every node, larger neighbours take the smallest neighbour."""
    either = links.select(F.col("child").alias("n"), F.col("parent").alias("m")).union(
        links.select(F.col("parent").alias("n"), F.col("child").alias("m"))
    )
    least = either.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
    return either.where("m > n").join(least, "n").select(F.col("m").alias("child"), F.col("least").alias("parent"))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, for all nodes that have a link to another one.

    ``links`` has two long columns, in any order and with repeats; links of a node to itself or to NULL count for
    nothing. No links give an empty table.
    """
    a, b = (F.col(f"`{c}`").cast("long") for c in links.columns)
    ordered = links.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent"))
    ordered = ordered.where("child > parent")
    while True:
        forest = materialize(point_down(point_up(merge_locally(ordered))).distinct(), "forest")
        # a star forest: one parent per child, and no parent is a child
        many = forest.groupBy("child").count().where("count > 1")
        chained = forest.join(forest.select(F.col("child").alias("parent")), "parent", "left_semi")
        if many.isEmpty() and chained.isEmpty():
            return forest.select(F.col("child").alias("node"), F.col("parent").alias("root")).union(
                forest.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct()
            )
        ordered = forest
