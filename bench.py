"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=... BENCH_CPUS=... python bench.py [--all] [name-prefix ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from proofgrid.plans import load_all
from proofgrid.plans.registry import QUERIES
from proofgrid.session import local_session

HEADLINE = [
    "p02_priority_top12", "p04_zone_groups", "p05_capture_batches", "s03_latest_entities", "s05_workspace_pages",
    "s11_camera_poses", "v03_first_over_quota", "v08_page_likeness", "u01_source_policy", "u07_reserved_addresses",
    "a05_candidate_scores", "a06_ranked_place", "g04_radius_candidates", "g06_best_building", "g11_preferred_frames",
    "d02_new_links", "d06_import_quota", "d09_text_search", "l01_json_answers", "l08_rewritten_tags", "l13_detections",
    "l14_cited_findings", "m01_mutual_matches", "m06_strongest_component", "m09_connection_tree", "m12_maximal_scenes",
    "m14_room_groups", "m19_bridge_edges", "q01_depth_buffer", "q05_similarity_fit", "q06_transformed_points",
    "q09_surface_matches", "q13_cross_view_votes", "q14_clamped_needles", "q20_weighted_median", "f02_merged_lines",
    "f06_structural_segments", "c02_plan_rooms", "c04_scene_labels", "e01_recall_precision", "t02_stage_fold",
    "t02_stage_fold_stream",
]


def main() -> None:
    args = sys.argv[1:]
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    load_all()
    names = list(QUERIES) if "--all" in args else HEADLINE
    picked = [a for a in args if not a.startswith("-")]
    if picked:
        names = [n for n in QUERIES if any(n.startswith(p) for p in picked)]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    QUERIES["t02_stage_fold"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM side
    times, begun = {}, time.perf_counter()
    limit = float(os.environ.get("BENCH_LIMIT_S", "1500"))  # no query is begun after it; what was timed is reported
    for name in names:
        start = time.perf_counter()
        if start - begun > limit:
            break
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "left_out": [n for n in names if n not in times], "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
