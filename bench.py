"""Time the headline queries; print one JSON line.

BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS    cores (default 8)
BENCH_RUNS    timed rounds over all queries after a warm-up round (default 3); medians are kept
BENCH_ALL     set to time every registered query
"""

from __future__ import annotations

import json
import os
import statistics
import time

from countersign import local_session
from countersign.plans.catalog import QUERIES

HEADLINE = (
    "review_stats",
    "backlog",
    "tx_reviewer_matrix",
    "latest_assignment",
    "remaining_by_reviewer",
    "visible_assignments",
    "amount_parse",
    "state_from_json",
    "csv_scan",
    "row_position",
    "stream_state",
    "stream_stats",
    "daily_pickup",
)


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def scale_of(folder: str) -> float | str:
    name = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    try:
        return float(name)
    except ValueError:
        return name


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = local_session(cores)
    for name in names:
        timed(spark, name, folder)
    rounds = [{name: timed(spark, name, folder) for name in names} for _ in range(runs)]
    seconds = {
        name: round(statistics.median(times[name] for times in rounds), 3) for name in names
    }
    result = {
        "metric": "headline_queries_total" if names is HEADLINE else "all_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": scale_of(folder),
        "cores": cores,
        "runs": runs,
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
