"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logrisk.operators import ml  # noqa: E402
from logrisk.plans.queries import REGISTERED, _samples  # noqa: E402
from logrisk.session import build_session, written  # noqa: E402

#: Runs of each query after the first.
WARM_RUNS = int(os.environ.get("BENCH_WARM_RUNS", "1"))

HEADLINE = [
    "log_parse", "log_explode", "risk_every_n", "log_features", "early_warning", "stream_calibration",
    "inactivity_sessions", "session_numbers", "job_labels", "job_features", "gpu_job_features",
    "borg_features", "roc_auc", "pr_points", "group_holdout", "group_folds", "normalise_lines",
    "etl_curate", "etl_batches", "risk_counts", "high_risk_per_session", "resource_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("logrisk-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        # The given files have one row group each.
        "spark.logrisk.deal": cpus,
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(os.path.join(folder, "events.parquet")).count()
    took, warm = {}, {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        runs = []
        for _ in range(1 + WARM_RUNS):
            start = time.perf_counter()
            REGISTERED[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - start, 3))
        took[name] = runs[0]
        if runs[1:]:
            warm[name] = statistics.median(runs[1:])
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "warm": warm, "score_ms_per_row": scoring(spark, folder),
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


def scoring(spark, folder: str) -> float:
    """Milliseconds to score a row with the full model (all rounds), over the held-out rows many times."""
    train, test = ml.prepared(_samples(spark, folder))
    model = ml.fit(ml.candidates()[ml.BOOSTED], train)
    rows = written(test.crossJoin(spark.range(50)).drop("id"), "bench-rows")
    n = rows.count()
    start = time.perf_counter()
    ml.score_batch(model, rows).write.format("noop").mode("overwrite").save()
    return round(1000 * (time.perf_counter() - start) / max(n, 1), 4)


if __name__ == "__main__":
    main()
