"""Times headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local threads), BENCH_QUERIES (comma list or
``all``). Every query runs once to warm up and once timed; all result columns are computed.
"""

from __future__ import annotations

import json
import logging
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "unread_by_topic_newest_week mentions_scoped_page mention_keyword_matches taxonomy_flat keyword_usage_by_topic "
    "insert_ignore_batch report_grouping_sets brand_profile brand_compare_share adaptive_rows digest_blocks "
    "url_normalized_dedup candidate_urls_capped config_suffix_match parsed_dates news_payload_scan rss_discovery "
    "keyword_feed_scan html_extract phrase_match_best_topic article_keyword_scores language_filter near_dedup "
    "historical_anti_join circuit_breaker metric_histogram_p95 sliding_rates_15m sustained_alerts counter_delta_last20 "
    "ingest_rows_to_store"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from newsloom import catalog
    from newsloom.session import build

    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    spark = build(f"local[{cpus}]", int(cpus))
    queries = catalog.queries()
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if asked == "all" else asked.split(",") if asked else HEADLINE
    times = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
