"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the cores. Each query is
planned and run to the end into the noop sink, which computes every row and column. Arguments, if
any, name the queries to run instead of the headline ones; ``all`` stands for every one.
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = (
    "fit_score", "score_breakdown", "latest_scan", "lead_chips", "lead_ranking", "crm_export", "lead_import",
    "lead_import_stats", "page_text", "page_links", "page_plan", "content_guard", "fresh_scan", "breaker_windows",
    "politeness_audit", "page_upsert", "normalized_text", "sentences", "signal_facts", "grounding_join",
    "grounding_corpus", "grounding_sources", "grounding_fuzzy", "fact_rank", "verdict_check", "judge_prompt", "scan_detail",
    "eval_report", "eval_cases", "note_prompt", "scan_outputs", "scan_batch", "lead_csv", "evidence_urls", "lead_list",
    "grounding_near", "page_text_untagged", "stream_latest", "stream_new_texts", "stream_import", "stream_breaker",
)


def session():
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("attesta-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from workload import all_queries

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    queries = all_queries()
    names = sys.argv[1:] or list(HEADLINE)
    if names == ["all"]:
        names = list(queries)
    spark = session()
    spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").count().collect()  # the session itself is not timed
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds, headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
