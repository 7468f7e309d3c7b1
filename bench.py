"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through Spark's ``noop`` sink (the whole plan executes, nothing is
collected to the driver). Times are wall-clock seconds on a warm session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["allowlist", "similarity_join", "match_decisions", "resume_vocabulary",
            "overlap_scores", "digest"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from lcarank.session import get_session

    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app_name="lcarank-bench")
    spark.sparkContext.setLogLevel("ERROR")
    from lcarank.plans.queries import QUERIES

    names = sys.argv[1:] or HEADLINE
    # warm-up: JVM, codegen caches and the Python workers of the two pandas UDFs
    QUERIES["allowlist_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    QUERIES["postings_ingest"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
