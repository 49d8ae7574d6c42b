"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

NAMES = [
    "window_scan", "class_census", "cell_evidence", "voxel_evidence", "surfaces", "interval_full", "estimate_summary", "edge_strength", "line_spread", "look_rank", "column_gap",
    "cube_scatter", "points_in_footprints", "corridor_cells", "tree_labels", "claims_bitmask", "overlap_matrix", "instance_extents", "roof_band", "pulses", "track_moments", "vec_neighbours",
]


def main() -> None:
    from plumbline.plans.registry import QUERIES
    from plumbline.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="6g")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["cell_evidence"](spark, sf).write.format("noop").mode("overwrite").save()  # start-up is not a query's
    took = {}
    for n in NAMES:
        t = time.time()
        QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
        took[n] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
