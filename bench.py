"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose tables and threads.
Each query runs once to warm up and once for the time; results are counted over all their columns.
"""

from __future__ import annotations

import json
import os
import time

from caravel.plans.queries import QUERIES
from caravel.session import local_session

HEADLINE = ("facet_hours_dense", "keyword_quartile", "tag_cloud", "loop_items", "route_gradient", "asof_nearest_altitude", "asof_bracket_position", "fill_position", "interval_best_track", "twilight_changes", "bursts_by_gap", "bursts_anchored", "scene_split", "best_of_group", "anti_chained", "dedup_first", "overlap_windows", "snapshot")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "16g")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, warm, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
