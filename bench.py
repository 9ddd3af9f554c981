"""Headline queries, timed warm; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from tidemark.checks import catalog  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = [
    "s1_read_articles",
    "p9_article_summary",
    "a1_top_entities",
    "a6_median_date",
    "a7_rank_clusters",
    "a10_cluster_info",
    "a17_constraint_audits",
    "c2_density_cluster",
    "c4_silhouette_sqeuclidean",
    "c5_news_events",
    "g2_degree_centrality",
    "j6_alert_fan_out",
    "o8_add_positions",
    "r2_retrieve",
    "r6_summarize_articles",
    "r7_process_events",
    "st1_rate_limit_audit",
    "t3_html_to_text",
    "v1_embed",
    "v4_knn_cosine",
    "v7_tfidf",
    "w4_top_events",
    "x4_statements_of_latest_filing",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run_once(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds,
             "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "runs": runs}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
