"""Headline queries at one scale factor; prints one JSON line.

Each query runs into the ``noop`` sink, so every output column is computed and
nothing is collected.  BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from rolecast.plans import registry  # noqa: E402

HEADLINE = (
    "normalize_links", "link_dedupe_survivor", "entity_survivors", "filter_reasons", "reason_histogram", "score_postings",
    "hydrated_view", "rank_top_k", "judgement_join", "board_join_priority", "cache_upsert", "feed_gupy", "feed_weworkremotely",
    "page_text", "page_links", "doc_normalized", "document_scores", "doc_fingerprint_duplicates", "doc_bigrams", "doc_pii_scan",
    "term_coverage", "source_yield_rollup", "status_transitions", "last_five", "running_value", "stream_daily_counts",
    "stream_status_fold",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("rolecast-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    wanted = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    per_second = {
        label: round(rows / seconds[q]) for label, q in (
            ("J03_resolve", "entity_survivors"), ("J05_filter", "filter_reasons"), ("J06_score", "score_postings")) if q in seconds}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "postings_per_sec": per_second, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
