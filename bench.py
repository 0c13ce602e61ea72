"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ONLY (comma-separated
key prefixes).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldweave.catalog import QUERIES  # noqa: E402
from fieldweave.session import build_session  # noqa: E402

HEADLINE = [
    "SRC1_scan_csv",
    "PRJ1_map_schema",
    "PRJ4_row_counter_id",
    "SCL1_normalize_name",
    "SCL8_ratios",
    "SCL14_convert_units",
    "SCL21_similarity_ratio",
    "GEO1_cell_of_point",
    "GEO3_ring_smooth",
    "GEO4_cell_cover",
    "GEO9_dissolve",
    "JON1_match_best",
    "JON2_match_best_name",
    "JON3_point_shape_left",
    "JON4_point_shape_buffered_remaining",
    "JON13_get_or_create",
    "PIP4_match_all_sources",
    "AGG1_merge_by_rules",
    "AGG5_flare_rollup",
    "AGG7_time_weighted_mean",
    "AGG13_distribution_summary",
    "WIN1_share_of_group",
    "WIN3_running_share",
    "WIN4_dense_renumber",
    "PIP1_standardize_source",
    "PIP8_merge_entities",
    "PIP9_attribute_flares",
    "PIP10_attribute_flares_monthly",
    "PIP12_basin_report",
    "PIP13_impact_curve",
    "PIP14_ingest_entry",
    "PIP17_estimate_missing",
    "STR2_flare_month_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    spark = build_session("bench", cores=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # one small pass first, so that JVM start-up is not charged to the first query
    QUERIES["PRJ5_rename_map"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for key in HEADLINE:
        if only and not any(key.startswith(p) for p in only):
            continue
        start = time.time()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - start, 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)$", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )


if __name__ == "__main__":
    main()
