"""Reading the transaction log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendcast.functions.scoring import null_for_nan
from spendcast.schema import ROW_TAG, TRANSACTION_SCHEMA


def read_transactions(
    spark: SparkSession, path: str, format: str = "csv", schema: T.StructType = TRANSACTION_SCHEMA
) -> DataFrame:
    """The log from CSV with a header, or from parquet; NaN amounts become NULL.

    ``row_tag`` tells exact copies of a line apart, so that they spread over tasks; it changes no value.
    """
    if format == "csv":
        # columns the task does not use may be in the file, so the header decides the positions
        header = spark.read.option("header", True).csv(path)
        # a text file has no row numbers; equal lines are numbered within their task
        tag = F.xxhash64("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
        raw = header.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], tag.alias(ROW_TAG))
    else:
        raw = spark.read.schema(schema).format(format).load(path)
        numbered = format == "parquet"
        tag = F.xxhash64("_metadata.file_path", "_metadata.row_index" if numbered else F.monotonically_increasing_id())
        raw = raw.select("*", tag.alias(ROW_TAG))
    doubles = [f.name for f in schema if isinstance(f.dataType, T.DoubleType)]
    return raw.withColumns({c: null_for_nan(F.col(c)) for c in doubles})


def copy_tag() -> Column:
    """One of some ten thousands of numbers: enough to spread copies of a row, and small where every row is moved."""
    return F.pmod(F.hash("_metadata.file_path", "_metadata.row_index"), F.lit(1 << 16))


def star_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines of a star schema as a transaction log; returned lines count negative.

    Sides are left to adaptive planning: it broadcasts by measured size and splits skewed join keys.
    """
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    nations = spark.read.parquet(f"{folder}/nation.parquet")

    sign = F.when(F.col("l_returnflag") == "R", F.lit(-1.0)).otherwise(F.lit(1.0))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    total = sign * F.col("l_extendedprice") * (1 - F.col("l_discount"))
    line_columns = lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        (sign * F.col("l_quantity")).alias("quantity"),
        price.alias("price"),
        total.alias("total"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("supplier_id"),
        copy_tag().alias(ROW_TAG),
    )
    homes = customers.join(nations, customers.c_nationkey == nations.n_nationkey).select(
        "c_custkey", F.col("n_name").alias("country")
    )
    # the narrow orders meet their customers first, so the lines are shuffled once, by order
    placed = orders.join(homes, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("o_custkey").alias("customer_id"), "country", F.col("o_orderdate").alias("order_date")
    )
    return (
        line_columns.join(placed, F.col("order_id") == F.col("o_orderkey"))
        .select(
            "order_id",
            "product_id",
            "customer_id",
            "country",
            "order_date",
            "quantity",
            "price",
            "total",
            "line_no",
            "supplier_id",
            ROW_TAG,
        )
    )


def event_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream read as a log, for keys that need real hours of the day."""
    value = F.col("value")
    return spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("event_id").alias("order_id"),
        F.col("event_type").alias("product_id"),
        F.col("user_id").alias("customer_id"),
        F.col("event_type").alias("country"),
        F.col("ts").alias("order_date"),
        value.alias("quantity"),
        value.alias("price"),
        value.alias("total"),
        F.lit(0).alias("line_no"),
        F.lit(0).cast("bigint").alias("supplier_id"),
        copy_tag().alias(ROW_TAG),
    )
