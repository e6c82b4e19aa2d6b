"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]`` and prints one JSON line.

``build_index`` is the time to derive and store the tables that the queries share (tiles, requests, entries, offsets,
leaves, headers, directory blobs, decoded directories, features), so no query pays for another; the other figures are one full run each, with every row computed and written to a sink that discards it.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "lookup_outcomes_by_zoom", "floor_entries", "hit_join", "missing_requests", "tree_lookup", "map_tiles", "run_length_entries",
    "assign_offsets", "offset_classes", "range_blocks", "decode_directories", "column_stats", "grid_classes", "layout_segments",
    "parse_headers", "payload_kinds", "decompress_payloads", "raster_sizes", "geometry_stats", "hit_test", "read_totals",
    "leaf_read_or_cache", "http_outcomes", "streaming_read_totals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tesserix.plans import q_archive, q_directory, q_features, tables
    from tesserix.plans.registry import all_queries
    from tesserix.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
                                                        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).groupBy("id").count().collect()  # start the executors
    queries, seconds = all_queries(), {}
    start = time.time()
    for build in (tables.requests, tables.leaves, q_archive.header_blobs, q_directory.blobs, q_directory.decoded, q_features.features):
        build(spark, sf_dir)
    seconds["build_index"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        queries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
