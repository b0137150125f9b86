"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds for each."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "text_search", "text_all", "text_any", "text_phrase", "text_prefix", "text_typo", "text_user", "filter_equals", "filter_range", "filter_under", "bool_or_not", "facet_value", "facet_range", "facet_hierarchy",
    "facet_sideways", "facet_nested", "sort_tiebreak", "page_keyset", "signal_decay", "rescore_window", "knn_exact", "fuse_rrf", "nested_filter", "nested_sort", "chain_sort", "value_hits", "suggest_prefix", "upsert",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quillspan.queries import QUERIES, prepare

    # as published search figures do, ours stand for searches of a built index; building is told apart
    began = time.perf_counter()
    prepare(spark, sf_dir)
    built = round(time.perf_counter() - began, 3)
    QUERIES["filter_equals"](spark, sf_dir).count()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "index_build_sec": built, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
