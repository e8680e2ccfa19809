"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` gives the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shortlist.session import local_session  # noqa: E402
from workload import views  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

RUNS = 3

HEADLINE = (
    "catalog_scan",
    "filter_combined",
    "filter_per_query",
    "lexical_index",
    "search_lexical",
    "search_vector",
    "search_vector_filtered",
    "search_vector_cells",
    "search_hybrid",
    "search_hybrid_filtered",
    "lookup_name",
    "repair_recommendations",
    "classify_intent",
    "extract_filters",
    "process_turns",
    "process_turns_answered",
    "response_fallback",
    "eval_recall",
)


def main(names: list[str]) -> None:
    """Run each query three times, results thrown away, and print the median times.

    The catalog index is stored before the clock starts.
    """
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    views.index(spark, sf_dir)
    times = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or list(HEADLINE))
