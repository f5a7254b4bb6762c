"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line.

Every query runs once to warm up and is then timed ``$BENCH_RUNS`` times
(default 3); the median is reported. Results go to the ``noop`` sink, so all
rows are computed but none are collected. The derived clinical tables are
written before the queries and timed on their own.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from symptomlake.session import build_local_session  # noqa: E402
from workload import adapter, registry  # noqa: E402

HEADLINES = [
    "weekly_daily_series", "weekly_report", "monthly_symptom_heatmap", "monthly_severity_by_day",
    "latest_triage", "triage_stats", "doctor_alerts", "care_panel", "streak_islands",
    "achievement_status", "question_responses", "clinical_summary", "free_slots", "timeline",
    "rate_issues", "flatten_symptoms", "section_results", "submission_messages", "stream_enrich", "stream_sessions",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINES
    spark = build_local_session("bench", cpus)
    seconds = {}
    start = time.perf_counter()
    adapter.assessments(spark, sf_dir)
    adapter.submissions(spark, sf_dir)
    seconds["derived_tables"] = round(time.perf_counter() - start, 3)  # written once per session
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
                      "cpus": cpus}))


if __name__ == "__main__":
    main()
