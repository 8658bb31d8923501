"""Headline queries on one set of tables; prints one JSON line.

Every query runs once to warm up and three times for its median. Inputs are
read from files in each run; results are collected in full.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tabsieve.checks.queries import QUERIES  # noqa: E402
from tabsieve.checks.views import table, view  # noqa: E402
from tabsieve.operators import chartdata, cleaning, quality  # noqa: E402
from tabsieve.plans.held import release_held  # noqa: E402

RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def issues(spark, folder):
    for found in quality.detect_issues(view(spark, folder, "messy"), ["l_orderkey"]).values():
        found.collect()


def chain(spark, folder):
    found = cleaning.clean(
        view(spark, folder, "messy"),
        [
            {"type": "remove_duplicates"},
            {"type": "fill_nulls", "column": "qty", "method": "median"},
            {"type": "fill_nulls", "column": "flag", "method": "mode"},
            {"type": "remove_outliers", "column": "qty"},
            {"type": "normalize", "column": "qty", "method": "minmax"},
            {"type": "fix_text", "column": "flag", "mapping": {"a": "A", "A ": "A", "n": "N", "N ": "N"}},
        ],
    )
    found.table.write.mode("overwrite").format("noop").save()


def histogram(spark, folder):
    for found in chartdata.chart_data(table(spark, folder, "lineitem"), "Histogram", "l_extendedprice").values():
        found.collect()


def collected(name):
    return lambda spark, folder: QUERIES[name](spark, folder).collect()


HEADLINE = {
    "profile": collected("profile_lineitem"),
    "issues": issues,
    "pearson": collected("pearson_pairs"),
    "spearman": collected("spearman_pairs"),
    "pearson_wide": collected("pearson_wide"),
    "pearson_gaps": collected("pearson_gaps"),
    "spearman_gaps": collected("spearman_gaps"),
    "clean_chain": chain,
    "histogram": histogram,
    "quantiles": collected("quantiles_distributed"),
    "regression": collected("linear_regression"),
    "outliers": collected("outlier_report_events"),
    "value_counts": collected("value_counts"),
    "scatter_grid": collected("scatter_grid"),
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tabsieve-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(Path(__file__).resolve().parent / "spark-warehouse" / "held"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, run in HEADLINE.items():
        run(spark, folder)
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run(spark, folder)
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    release_held(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "median seconds of the headline queries, summed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": cpus,
                "shuffle_partitions": cpus,
                "runs": RUNS,
            }
        )
    )


if __name__ == "__main__":
    main()
