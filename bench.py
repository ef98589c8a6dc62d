"""Time the headline queries and print one JSON line.

The tables are read from $BENCH_SF_DIR on local[$BENCH_CPUS]; each query is built and written to
the ``noop`` sink, which computes every row and column.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from reckoner.queries import QUERIES

HEADLINE = (
    "confusion_by_lang", "evaluation_tables", "report_difficulty", "bootstrap_f1_rows", "score_responses",
    "dense_ids", "running_totals", "split_payments", "labelled_pairs", "attach_rows", "rule_match_f1",
    "few_shot_requests", "pair_requests", "request_audit", "normalise_kna", "reassemble_source",
    "perturb_table", "linearize_rows", "generated_invoices", "generated_payments", "json_round_trip",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
