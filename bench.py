"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from pricelens.plans.catalogue import load
from pricelens.session import build_session

HEADLINE = ["tier_assign", "decision_notes", "union_sources", "status_timeline", "price_events", "market_median", "scam_flags", "state_merge",
            "alert_stream", "daily_digest", "listing_page", "scan_counters", "watch_stats", "source_health", "scan_completeness",
            "text_normalize", "classify_keywords", "classify_drives", "classify_pc", "ingest_lbc_listings", "ingest_card_pages", "html_to_text"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus, 2 * cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    queries["tier_assign"](spark, sf).write.format("noop").mode("overwrite").save()  # warm the JVM
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
