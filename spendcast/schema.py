"""Column names, types and fixed parameters of the transaction log."""

from __future__ import annotations

from pyspark.sql import types as T

# Spend threshold and seed of the prediction task.
SPEND_THRESHOLD = 300
SEED = 42

TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("country", T.StringType()),
        T.StructField("order_date", T.TimestampNTZType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("total", T.DoubleType()),
    ]
)

# Money and quantities are added up as whole numbers and units of 10^-7, two integers, so a sum is the same whatever
# the partitioning, the order of arrival or a repeated task. Units add up over some 10^11 rows, whole numbers to 10^18.
PLACES = 7

# Running totals follow this order. It holds all that is summed and all keys, so rows equal in it are interchangeable.
LOG_ORDER = (
    "order_date", "order_id", "line_no", "product_id", "supplier_id", "customer_id", "country", "quantity", "total", "price"
)
# Only spreads exact copies of one order line over several tasks; see sources.transactions.
ROW_TAG = "row_tag"

VALUES = ("total", "quantity", "price")
# Running-total key column -> the name it carries in the output column.
RUNNING_KEYS = {
    "customer_id": "cust_id",
    "product_id": "prod_id",
    "order_id": "order_id",
    "country": "country",
    "order_date_year": "year",
    "order_date_year_month": "year_month",
    "order_date_hour": "hour",
}
# Statistics taken per customer, and columns counted distinctly.
STATISTICS = ("mean", "max", "min", "sum", "count", "std", "skew")
DISTINCT_COLUMNS = (
    "order_id",
    "product_id",
    "country",
    "order_date_year_month",
    "order_date_year",
    "order_date_hour",
)


def running_column(value: str, key: str) -> str:
    return f"cumsum_{value}_by_{RUNNING_KEYS[key]}"


RUNNING_COLUMNS = tuple(running_column(v, k) for k in RUNNING_KEYS for v in VALUES)
MEASURES = ("quantity", "price", "total") + RUNNING_COLUMNS


def feature_column(column: str, statistic: str, separator: str = "__") -> str:
    return f"{column}{separator}{statistic}"


FEATURES = tuple(feature_column(c, s) for c in MEASURES for s in STATISTICS) + tuple(
    feature_column(c, "nunique") for c in DISTINCT_COLUMNS
)
