"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tessera.plans import catalogue
from tessera.session import session

HEADLINE = ("cur_candidates", "cur_counts", "ann_runs", "ann_merge_ranges", "ann_window_max", "str_means_of_means", "str_quality_score", "sel_general", "sel_representatives", "sel_first_non_null", "rec_series_summary", "dock_topn_fallback", "dock_grid_clusters", "dock_contacts", "md_window_stats", "md_occupancy", "md_pivots", "md_top_contacts")


def main() -> None:
    at = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, at).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(sorted(runs[1:])[0], 4)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(at)}))


if __name__ == "__main__":
    main()
