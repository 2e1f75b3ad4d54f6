"""Headline queries over logs rendered from lineitem: one JSON line with seconds for each.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the threads (default 8). Rendering the log files is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from datetime import datetime
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
sys.path.insert(0, ROOT)


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from logspark.functions.match import Pattern
    from logspark.operators import table as T
    from logspark.operators.entries import read_logs
    from logspark.sources.scratch import new_folder

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    level = F.when(F.col("l_returnflag") == "R", "ERROR").when(F.col("l_returnflag") == "A", "WARN").otherwise("INFO")
    head = F.concat(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), level, F.lit(" order "), "l_orderkey", F.lit(" line "), "l_linenumber",
        F.lit(" part "), "l_partkey",
    )
    # Every tenth entry has two lines more, as a stack trace would.
    text = F.when(
        F.col("l_partkey") % 10 == 0,
        F.concat(head, F.lit("\n  at supplier "), "l_suppkey", F.lit("\n  at quantity "), F.col("l_quantity").cast("string")),
    ).otherwise(head)
    folder = new_folder(spark, "bench-logs")
    rows.repartitionByRange(8, "l_shipdate").sortWithinPartitions("l_shipdate").select(text.alias("value")).write.text(folder)
    entries = lambda: read_logs(spark, [folder], max_lines=0)
    kept = new_folder(spark, "bench-entries")
    spec = T.FilterSpec(frozenset(["ERROR"]), datetime(1995, 1, 1), datetime(1996, 1, 1))
    parsed = lambda: spark.read.parquet(kept)
    runs = {
        "open_fold_parse": lambda: entries().write.parquet(kept),
        "open_level_counts": lambda: T.level_counts(entries()).collect(),
        "level_counts": lambda: T.level_counts(parsed()).collect(),
        "filter_level_time": lambda: T.apply_filter(parsed(), spec).agg(F.count(F.lit(1))).collect(),
        "filter_keyword": lambda: T.shown_of_total(parsed(), T.FilterSpec(pattern=Pattern("part 155"), columns=("message",))).collect(),
        "find_matches": lambda: T.find_matches(parsed(), Pattern("part 155"), ["message"]).agg(F.count(F.lit(1))).collect(),
        "merge_sources": lambda: T.merge_documents(parsed())[0].write.format("noop").mode("overwrite").save(),
    }
    took = {}
    for name, run in runs.items():
        began = time.time()
        run()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({
        "metric": "log_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": float(sf_dir.rstrip("/").rpartition("sf")[2] or 0),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
