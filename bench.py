"""Times the headline queries on one machine and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame

from checks.queries import queries, tx
from spendcast.operators.running_totals import order_log, running_totals, running_totals_by_window
from spendcast.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "transactions",
    "generate_labels",
    "baseline_no_ml",
    "cumsum_by_cust",
    "cumsum_by_hour",
    "feat_nunique",
    "customer_snapshot_features",
    "feature_engineering",
    "feature_engineering_whole_log",
    "roc_auc",
    "stratified_folds",
    "gbt_oof",
)


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    run(tx(spark, FOLDER))  # start-up and the first scan are not part of any query
    everything = queries()
    timed = {name: (lambda q=everything[name]: q(spark, FOLDER)) for name in HEADLINE}
    timed["running_totals_all_keys"] = lambda: running_totals(order_log(tx(spark, FOLDER)))
    timed["running_totals_plain_windows"] = lambda: running_totals_by_window(tx(spark, FOLDER))
    seconds = {}
    for name, query in timed.items():
        started = time.time()
        run(query())
        seconds[name] = round(time.time() - started, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
