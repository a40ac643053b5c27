"""Times the headline queries and prints one JSON line.

Every query runs to the end on its whole tables; the rows go to Spark's no-op
sink, so neither the driver nor a disk is part of the time.
"""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskweave.plans import catalog  # noqa: E402

HEADLINE = [
    "last_event_date",
    "windows_disjoint",
    "events_in_window_diag",
    "events_in_window_lab",
    "events_in_window_note",
    "feature_count_med",
    "feature_avg_lab",
    "note_word_count",
    "entity_word_count",
    "entity_tfidf",
    "feature_index",
    "sparse_rows",
    "entity_label",
    "hash_split",
    "eval_report",
    "cohort_stats",
    "pipeline_baseline_tuples",
    "pipeline_wordcount_tuples",
    "pipeline_tfidf_tuples",
    "fit_predict_logistic",
    "fit_predict_tree",
    "fit_predict_gbt",
    "pipeline_baseline_metrics",
    "pca_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="riskweave-bench-"))
        # The tables are single small files: smaller splits keep all cores at work.
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    wanted = sys.argv[1:] or HEADLINE
    # One small query first, so that start-up is not charged to the first one.
    queries["hash_split"](spark, folder).count()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
