"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, or 'all').
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from broadsheet.plans import catalog  # noqa: E402
from broadsheet.session import local_session  # noqa: E402

HEADLINE = [
    "canonical_urls", "title_keys", "rule_matches", "prepared_items", "interest_scores", "assessment_gate",
    "freshness_and_rank_scores", "edition_picks", "keyword_coverage_picks", "rss_entries", "page_titles_bodies",
    "listing_articles", "repo_scores", "rank_history", "delivered_antijoin", "candidate_upsert", "retention_split",
    "source_coverage", "analysis_plan", "report_assignments", "stream_candidates",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.PLANS) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times, failed = {}, {}
    for name in names:
        start = time.perf_counter()
        try:
            catalog.PLANS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
            print(name, times[name], file=sys.stderr, flush=True)
        except Exception as exc:  # noqa: BLE001 - one broken query must not hide the others' times
            failed[name] = str(exc)[:200]
    out = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
