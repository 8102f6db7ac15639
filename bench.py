"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from audira.plans import all_queries  # noqa: E402
from audira.session import local_session  # noqa: E402

HEADLINE = [
    "entity_step_mean",
    "overview_performance",
    "kpi_vs_group",
    "rank_neighbors",
    "kpi_percentiles",
    "step_segment_gap",
    "growth_grades",
    "person_composite_score",
    "similar_persons",
    "prelaunch_features_full",
    "ridge_log_regression",
    "channel_totals",
    "search_catalog_pushdown",
    "comment_sample",
    "session_activity",
    "stream_daily_views",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "audira-bench")
    queries = all_queries()
    # Warm up the session, not the queries.
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
