"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from webloom.plans import catalogue  # noqa: E402
from webloom.session import local_session  # noqa: E402

HEADLINE = [
    "extraction_report",
    "html_to_markdown",
    "raw_fallback",
    "search_plain",
    "search_regex",
    "search_fuzzy",
    "search_context",
    "read_section",
    "waterfall_decide",
    "cache_upsert",
    "cache_stats",
    "session_list",
    "link_dup_table",
    "eval_category_rollup",
    "host_gap_fold",
    "llms_match",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "0")) or None, app="bench")
    run = lambda name: catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])  # starts the workers and compiles once
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
