"""Runs the headline queries and prints one JSON line with the seconds each took."""

from __future__ import annotations

import json
import os
import time

from linkloom.plans import catalog
from linkloom.session import local_session

HEADLINES = (
    "all_shortest_paths", "bidirectional_paths", "bfs_layers", "crawl_generations", "path_chain", "internal_links", "internal_links_parsed", "resolved_edges",
    "dangling_links", "pending_sources", "late_edge_completion", "adjacency_listing", "neighbour_sets", "page_changes", "upsert_pages", "recrawl_admission", "worker_report",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    queries = catalog.queries()
    queries["part_edges"](spark, sf).count()  # starts the machine
    took = {}
    for name in HEADLINES:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "page_graph_headlines_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
