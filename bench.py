"""Headline queries, timed warm; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from drawbom.plans.catalogue import PLANS  # noqa: E402
from drawbom.session import local_session  # noqa: E402

HEADLINE = [
    "p5_score_page_labels", "p6_select_pages", "g2_iou_pairs", "g8_merge_row_bands", "l6_assign_band", "l7_split_wide_gaps", "l10_header_y_by_band",
    "f16_parse_combo", "b5_count_breakers", "v1_dedupe_names", "v5_suppress_bad_panels", "r1_resolve_settings", "r8_required_spaces", "r9_family_screen",
    "r11_snap_up", "r12_build_branch_nq", "r13_build_branch_nf", "r15_search_lug_panel", "r16_search_breaker_panel", "r23_mccb_part_number",
    "r25_resolve_disconnects", "r26_resolve_transformers", "m3_order_bom", "m7_bom_totals", "j1_latest_job_state", "j4_job_progress", "j7_inflight_by_owner",
]


def run(spark, sf_dir, name):
    start = time.perf_counter()
    PLANS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    run(spark, sf_dir, "m7_bom_totals")
    times = {name: round(run(spark, sf_dir, name), 3) for name in HEADLINE}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


main()
