"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names)
"""

from __future__ import annotations

import json
import os
import sys
import time

from wlanlake.catalog import queries
from wlanlake.session import build_session

HEADLINE = [
    "frame_features",
    "causal_rollups",
    "model_row",
    "training_windows",
    "attack_series_hour",
    "heatmap",
    "top_offenders",
    "report_summary",
    "estimate_origin",
    "detection_view",
    "dedupe_latest",
    "iqr_outliers",
    "per_class_metrics",
    "split_overlap",
    "stream_rollups",
]
# Of these the rate of frames per second is told as well.
PER_FRAME = ["frame_features", "causal_rollups", "model_row", "stream_rollups"]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    registered = queries()
    frames = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).count()
    # One small query first, so that starting the JVM's code paths is not billed to the first one.
    registered["packets_count"](spark, sf_dir).collect()
    took = {}
    for name in names:
        t = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
        print(f"{name}: {took[name]}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "frames_per_sec": {n: round(frames / took[n]) for n in PER_FRAME if n in took},
            }
        )
    )
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
