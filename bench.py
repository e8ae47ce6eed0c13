"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line of seconds, the best of the timed runs."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "salami_rolling_90d", "salami_realert", "pattern_alerts", "name_subset_pairs", "amount_match_pairs", "open_deal_matches", "asof_ttl_lookup", "market_cap_lookup", "first_to_surface", "query_attribution",
    "ticker_resolution", "seen_anti_join", "upsert_counter", "topk_per_group", "feedback_breakdown", "stats_full_outer", "clusters_merged", "shadow_report", "normalise_title", "title_near_dup", "title_dedup_shadow",
    "amount_regex", "proximity_gate", "stake_percent", "date_multi_format", "money_format", "html_links", "json_extract_agg", "large_deal_rows", "disclosure_rows", "stage_batches", "size_gates",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from tradesift.plans import catalog

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    taken: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        taken[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
