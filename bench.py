"""Headline queries, timed. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs once to warm up and then BENCH_RUNS times (default 3); the median
counts. Results are written to a sink that discards them, so every row is computed.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from issuelens import build_session  # noqa: E402
from issuelens.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "clean_score_evaluate",
    "clean_documents",
    "extract_document_texts",
    "dedup_keep_first",
    "balance_classes",
    "stratified_split",
    "kfold_assign",
    "split_job_by_group",
    "linear_score",
    "score_with_user_model",
    "ensemble_long",
    "model_columns",
    "metrics_binary",
    "metrics_by_source",
    "roc_curve",
    "one_vs_rest_auc",
    "classification_report_multiclass",
    "debt_density",
    "csv_round_trip",
    "stream_density_tumbling",
    "stream_dedup",
]


def run(spark, folder, name):
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, folder, name)
        seconds[name] = round(statistics.median(run(spark, folder, name) for _ in range(runs)), 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
