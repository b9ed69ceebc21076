"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``load_enrich`` is the one-time build of the enriched content table
(adaptor joins, validation, enrichment, rolling means, write). Every other
query runs over that written table, as each analysis does over the loaded
dataset. Each query is forced with the no-op sink, so the timing is the full
computation without collecting rows to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "kpi_totals", "by_category", "by_thumbnail_style", "monthly", "category_lift", "weekday_calendar",
    "correlations_to_views", "normal_range", "recommendations", "rolling_tail", "top_videos", "filter_content",
    "title_tfidf", "similar_titles", "title_token_lift", "ab_test_attribute", "ab_test_title", "ab_test_full",
    "standardized_features", "silhouette_by_group", "segment_labels", "percentile_flag", "r2_group_mean",
    "anomaly_scores", "anomaly_sweep", "cluster_sweep", "metadata_signal", "dedup_keep_first", "csv_export",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from viewscope.session import local_session
    from viewscope.plans.catalog import REGISTRY
    from viewscope.plans.content import content_table

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, app="viewscope-bench")
    times: dict[str, float] = {}
    t0 = time.perf_counter()
    content_table(spark, sf_dir)
    times["load_enrich"] = round(time.perf_counter() - t0, 3)
    names = [n for n in HEADLINE if n in REGISTRY]
    if len(sys.argv) > 1:
        names = [n for n in sys.argv[1:] if n in REGISTRY]
    for name in names:
        t = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
