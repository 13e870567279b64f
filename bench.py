"""Benchmark the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_REPEAT (default 3; the median is reported), BENCH_QUERIES
(comma-separated keys, default the headline set).  Each run executes the
whole plan into Spark's ``noop`` sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tokenloom.catalog import QUERIES  # noqa: E402
from tokenloom.session import build_session  # noqa: E402

HEADLINE = [
    "daily_usage", "usage_all", "cap_crossing_call", "latency", "apply_outcomes", "replay_attempts",
    "recover_timeouts", "validate", "conversation_screen", "sanitize_html", "pii_flag", "entity_text",
    "missing_vectors", "parse_call_log", "vector_upsert", "cosine_topk", "embed_entities",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    keys = [k for k in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if k]
    spark = build_session(f"local[{cpus}]", cpus)
    QUERIES["task_log"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    times: dict[str, float] = {}
    first: dict[str, float] = {}
    for key in keys:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        first[key] = round(runs[0], 3)
        times[key] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total_median_wall", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "first_run": first, "sf": sf, "cpus": cpus,
        "repeat": repeat, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
