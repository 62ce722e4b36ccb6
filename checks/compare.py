"""Run registered queries next to their SQL and report differences: ``python -m checks.compare [folder] [name…]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from checks.oracles import oracle_sql
from checks.queries import queries
from spendcast.session import local_session


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(set(left.columns) ^ set(right.columns))}"
    if len(left) != len(right):
        return f"rows {len(left)} and {len(right)}"
    left, right = normal(left), normal(right)
    kinds = [c for c in left if left[c].dtype.kind != right[c].dtype.kind]
    if kinds:
        return "types " + ", ".join(f"{c}: {left[c].dtype} and {right[c].dtype}" for c in kinds[:5])
    for c in left:
        same = (left[c] == right[c]) | (left[c].isna() & right[c].isna())
        if not same.all():
            at = same.idxmin()
            return f"{c}: {(~same).sum()} differ, first {left[c][at]!r} and {right[c][at]!r}"
    return None


def main(folder: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(folder), oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            result = query(spark, folder).toPandas()
            verdict = difference(result, con.execute(sql[name]).df()) if name in sql else None
        except Exception as e:
            result, verdict = [], f"{type(e).__name__}: {str(e)[:500]}"
        failed += verdict is not None
        kind = "sql " if name in sql else "rows"
        print(f"{'FAIL' if verdict else 'ok  '} {kind} {name} {len(result)} rows {time.time() - started:.1f}s {verdict or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
