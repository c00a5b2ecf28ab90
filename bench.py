"""Headline queries on one machine: prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the threads. The text is written
before the clock starts; every query then reads it anew.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rectio-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from rectio.plans import queries as q

    path = q.lineitem_text(spark, sf_dir)
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path.removeprefix("file://")) for f in names)
    every = q.queries()
    runs = {
        "read_full": lambda: q.read_lineitem(spark, sf_dir),
        "read_two_columns": lambda: q.read_lineitem(spark, sf_dir, col_select=["l_orderkey", "l_quantity"]),
        **{name: (lambda f=every[name]: f(spark, sf_dir)) for name in ("filter_group_mean_lineitem", "group_sum_lineitem", "filter_numeric_lineitem", "head_lineitem", "sample_100_lineitem", "quoted_newlines_documents", "quoted_json_events", "delim_guess_orders", "fwf_overlap_orders", "lines_documents", "problems_customer")},
    }
    sinks = {"write_lineitem": lambda: q.rendered(q._table(spark, sf_dir, "lineitem"), "|")}
    took: dict[str, float] = {}
    for name, make in (runs | sinks).items():
        best = None
        for _ in range(2):  # the first run compiles
            began = time.time()
            make().write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
            if best > 15:
                break
        took[name] = round(best, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": total, "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "lineitem_text_mb": round(size / 1e6, 1), "read_full_mb_per_sec": round(size / 1e6 / took["read_full"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
