"""Time the headline queries and print one JSON line.

Inputs come from ``$BENCH_SF_DIR``; results are computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

from trackloom.catalog import entries
from trackloom.session import local_session, scope

HEADLINE = ("error_summary", "ensemble_median", "method_errors", "error_table", "error_by_cluster", "error_stats", "velocity",
            "pose_features", "detect_saccades", "saccade_consensus", "triangulate", "triangulate_pairs",
            "leave_one_view_out", "reprojection_error", "mahalanobis", "smooth_single_view", "session_difference",
            "threshold_sweep", "remove_worst_share", "frames_to_label")


def main() -> int:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus), app="trackloom-bench")
    known = entries()
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    for name in names:  # start workers and compile on the smallest data
        with scope(spark):
            known[name].build(spark, small if os.path.isdir(small) else sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        with scope(spark):
            t0 = time.perf_counter()
            known[name].build(spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
