"""Calendar keys, month arithmetic and month filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_start(year_month: str) -> dt.datetime:
    return dt.datetime.strptime(year_month, "%Y-%m")


def month_offset(year_month: str, months: int) -> str:
    """The month ``months`` before ``year_month``, both as ``YYYY-MM``."""
    start = month_start(year_month)
    number = start.year * 12 + start.month - 1 - months
    return f"{number // 12:04d}-{number % 12 + 1:02d}"


def month_offset_column(year_month: Column, months: int) -> Column:
    return F.date_format(F.add_months(F.to_date(year_month, "yyyy-MM"), -months), "yyyy-MM")


def derive_time_keys(df: DataFrame, date: str = "order_date", prefix: str = "order_date_") -> DataFrame:
    """Zero-padded string keys for year-month, year and hour of day."""
    c = F.col(date)
    return df.withColumns(
        {
            f"{prefix}year_month": F.date_format(c, "yyyy-MM"),
            f"{prefix}year": F.date_format(c, "yyyy"),
            f"{prefix}hour": F.date_format(c, "HH"),
        }
    )


def moment(df: DataFrame, year_month: str, date: str = "order_date") -> Column:
    """First instant of a month as a constant of the date column's own type."""
    text = f"{month_start(year_month):%Y-%m-%d %H:%M:%S}"
    return F.lit(text).cast(df.schema[date].dataType)


def filter_before_snapshot(df: DataFrame, year_month: str, date: str = "order_date") -> DataFrame:
    return df.where(F.col(date) < moment(df, year_month, date))


def filter_through_month(df: DataFrame, year_month: str, date: str = "order_date") -> DataFrame:
    return filter_before_snapshot(df, month_offset(year_month, -1), date)


def filter_month(df: DataFrame, year_month: str, date: str = "order_date") -> DataFrame:
    return filter_through_month(df, year_month, date).where(F.col(date) >= moment(df, year_month, date))
