"""Times the headline queries on whole tables and prints one JSON line.

BENCH_SF_DIR  folder with the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)

Each query runs three times and the fastest counts, so that the session is warm; results go to Spark's noop sink, so every
row and column is computed.  The first run, which plans and generates code, is reported beside it.  ``scan_table`` also runs on the tables of a tenth of the
size, if they lie beside the given ones, which parts the seconds that any run takes from those that grow with the text.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession, functions as F

from checks.catalog import QUERIES
from checks.corpus import document_corpus

HEADLINE = ("scan_table", "scan_files", "candidate_rules", "rule_matches", "match_context", "entropy",
            "scan_union_roots", "scan_custom_rule", "scan_history", "baseline_compare", "verify_join",
            "file_summary", "sarif_results", "csv_rows", "composite_rules", "findings_by_hour", "after_scan")


def session(cpus: str) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cpus}]").appName("keysift-bench")
            .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", cpus)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="keysift-bench-")).getOrCreate())


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds, first = {}, {}
    for name in HEADLINE:
        runs = timed(spark, folder, name)
        seconds[name], first[name] = min(runs), runs[0]
        print(f"{name}: {seconds[name]} s, first {first[name]} s", file=sys.stderr, flush=True)
    size = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    megabytes = text_mb(spark, folder)
    line = {
        "metric": "total seconds of the headline queries, warm", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": size, "scan_table_mb_per_sec": round(megabytes / seconds["scan_table"], 1),
        "text_mb": round(megabytes, 1), "first_run": first}
    smaller = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.01")
    if size == "0.1" and os.path.isdir(smaller):
        less, few = text_mb(spark, smaller), min(timed(spark, smaller, "scan_table"))
        grown = max(seconds["scan_table"] - few, 0.0)
        line |= {"scan_table_growing_mb_per_sec": round((megabytes - less) / grown, 1) if grown else None,
                 "scan_table_fixed_sec": round(max(few - grown / (megabytes - less) * less, 0.0), 3)}
    print(json.dumps(line))


def timed(spark: SparkSession, folder: str, name: str, runs: int = 3) -> list[float]:
    out = []
    for _ in range(runs):
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        out.append(round(time.time() - start, 3))
    return out


def text_mb(spark: SparkSession, folder: str) -> float:
    return document_corpus(spark, folder).agg(F.sum(F.octet_length("content")) / 1e6).first()[0]


if __name__ == "__main__":
    main()
