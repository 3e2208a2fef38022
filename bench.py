"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quarry.plans import catalog

HEADLINE = (
    "q_term_keyword", "q_terms", "q_range_number", "q_range_date", "q_prefix", "q_wildcard", "q_fuzzy", "q_match_or", "q_match_and", "q_match_phrase", "q_query_string", "q_bool", "q_minimum_should_match", "q_has_child", "q_nested",
    "q_tfidf_match", "q_postings_bm25", "q_function_score", "q_script_score", "q_sort_multi", "q_search_after", "q_agg_terms", "q_agg_range", "q_agg_composite", "q_agg_sub_terms", "q_top_hits", "q_agg_stats", "q_knn_cosine", "q_rrf", "q_geo_distance", "q_analyze_simple", "q_percolate",
)


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = catalog.queries()
    queries["q_term_keyword"](spark, sf).count()  # starts the session's threads
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 4)
    print(json.dumps({"metric": "search_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
