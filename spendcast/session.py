"""Session set-up and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "spendcast") -> SparkSession:
    """A session for tests and the local benchmark. On a cluster, pass your own session instead."""
    return configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def configure(spark: SparkSession) -> SparkSession:
    """Settings the jobs rely on: UTC, adaptive plans, and code generation for tables of 176 columns.

    A skewed join is split even where that costs a shuffle: an aggregate by the join key may follow it.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.codegen.maxFields", "500")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    A folder of our own is made only for a local master that names none; on a cluster a missing
    setting is an error, because a machine-local folder does not survive the loss of an executor.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spendcast-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, to be dropped with the application."""
    return f"{scratch_root(spark)}/spendcast-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# Remove the shuffle files of a query when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of it: lineage ends here, columns and filters still prune.

    The shuffle files that made it are removed with the end of the write; until then they serve tasks that are repeated.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path, partitionBy=partition_by, compression=compression)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    # with its schema given, reading back starts no job and a partition column keeps its type
    table = spark.read.schema(df.schema).parquet(path)
    if (written := _written.get()) is not None:
        written[path] = table
    return table


# The tables written within the innermost ``freed``, by path.
_written: ContextVar[dict[str, DataFrame] | None] = ContextVar("written", default=None)


class Kept:
    def __init__(self):
        self.tables: list[DataFrame] = []

    def keep(self, table: DataFrame) -> DataFrame:
        self.tables.append(table)
        return table


@contextmanager
def freed(spark: SparkSession) -> Iterator[Kept]:
    """Tables that ``materialize`` writes inside, by this thread, are removed at the end.

    What is read later goes through ``keep``, as ``materialize`` returned it; one ``freed`` around this one may remove it.
    """
    outer, own, kept = _written.get(), {}, Kept()
    token = _written.set(own)
    try:
        yield kept
    finally:
        _written.reset(token)
        for path, table in own.items():
            if any(table is k for k in kept.tables):
                if outer is not None:
                    outer[path] = table
                continue
            remove(spark, path)


def discard(table: DataFrame, part: str = "") -> None:
    """Remove a table that ``materialize`` wrote within the innermost ``freed``, or one folder of it, as nobody reads it any more."""
    for path, known in (_written.get() or {}).items():
        if known is table:
            remove(table.sparkSession, f"{path}/{part}".rstrip("/"))


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
