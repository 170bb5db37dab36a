"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated
names, or "all").
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rolegrid.catalog import QUERIES  # noqa: E402
from rolegrid.session import local_session  # noqa: E402

HEADLINE = [
    "w1_accepted_answer_per_run", "w2_j8_churn_with_company", "w2_event_type_changes", "w3_latest_run_per_company",
    "w5_w6_sweep_plan", "w7_failure_streak_stop", "w9_step_latency_percentiles", "w11_first_wins_dedupe",
    "a5_run_stats", "a6_x5_nearest_index_percentiles", "a9_trace_digest", "a11_error_summary", "a14_run_facts",
    "a16_sweep_outcomes", "d1_posting_upsert", "d3_mark_stale_platform_scope", "d7_index_upsert", "d13_run_ledger_fold",
    "d15_posting_backfill", "d26_attempt_sink", "j6_scrape_targets", "j15_vendor_reference_scan", "u2_provenance_union",
    "p1_j1_job_projection", "s8_log_line_parse", "f5_normalise_url", "f20_p25_block_classifier",
    "f23_w13_best_anchor_scores", "f32_location_classify", "f34_feed_normalise",
    "d20_vendor_classification_job", "d21_feed_ingest_job", "d22_index_ingest_job", "d23_careers_resolution_job",
    "d24_f25_stored_url_validation_job", "d25_listings_job",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if asked == "all" else [x for x in asked.split(",") if x] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="rolegrid-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        # The noop sink runs the whole plan without moving rows to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
