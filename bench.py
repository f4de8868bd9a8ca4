"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores, BENCH_QUERIES a comma
separated choice ("all" for every query). Each query runs once to warm up the
JVM and the Python workers and is then timed; its whole result is produced and
discarded by Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from framesift.plans.queries import QUERIES  # noqa: E402
from framesift.session import build_session  # noqa: E402

HEADLINE = [
    "image_records",
    "folder_stats",
    "embed_text",
    "embed_images",
    "ai_query_text",
    "entities",
    "index_rows",
    "vector_profile",
    "knn_single",
    "knn_prefilter",
    "knn_batch",
    "knn_batch_by_cells",
    "knn_batch_l2_by_cells",
    "search_cells",
    "search_text",
    "search_postfilter",
    "hits_with_content",
    "change_feed",
    "sync_available_now",
    "sync_updates",
    "sync_compacted",
    "logged_changes",
    "exact_duplicates",
    "exact_duplicate_members",
    "near_duplicates",
    "near_duplicates_by_cells",
    "near_duplicates_lsh",
    "duplicate_groups",
    "duplicate_groups_by_cells",
    "duplicate_groups_lsh",
    "savings",
    "zero_shot_label",
    "kmeans_sizes",
]


def run(build, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = build_session(
        app_name="bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(QUERIES[name], spark, sf_dir)
        seconds[name] = round(run(QUERIES[name], spark, sf_dir), 3)
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
