"""Wall time of the headline queries. Prints one JSON line.

``BENCH_SF_DIR`` names the data (default sf0.1), ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` how often each
query is timed (default once; the median counts). Every query is run to its last row (a sum over a hash of all
columns); sessions are warm. ``build`` is the part of a time spent before the last job, in stages.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from scanflow.plans import registered
from scanflow.session import build_session

HEADLINE = [
    "gaze_frame_clock", "frame_average", "dense_frames", "fixations", "movements", "movement_actions",
    "overlap_captions", "nearest_event", "next_purchase", "context_present", "projected_gaze", "tracked_trail",
    "scene_consistency", "timeline_merged", "episodes", "episode_objects", "merged_appearances", "recent_context",
    "gazed_so_far", "similar_name_pairs", "ask_next_after_group", "ask_never_gazed", "ask_transition_pattern",
    "ask_scene_recall", "ask_identify_easy", "ask_next_action", "ask_alert_appear", "filter_next_after_group",
    "filter_identify", "score_choice", "score_latency", "score_overall", "leaderboard_pivot", "stream_fixations",
]


def run(spark, fn, sf_dir: str) -> tuple[float, float]:
    """Seconds in all, and until the query was built."""
    begin = time.time()
    df = fn(spark, sf_dir)
    built = time.time() - begin
    df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).collect()
    return time.time() - begin, built


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(cpus, app="scanflow-bench")
    run(spark, registered.QUERIES["score_choice"], sf_dir)
    run(spark, registered.QUERIES["stub_predictions"], sf_dir.replace("sf0.1", "sf0.001"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    timed = {name: sorted(run(spark, registered.QUERIES[name], sf_dir) for _ in range(runs))[runs // 2] for name in names}
    times = {name: round(t[0], 3) for name, t in timed.items()}
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "build": {name: round(t[1], 3) for name, t in timed.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
