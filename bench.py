"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is fully executed into Spark's no-op sink (nothing is collected
to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sitesift.plans.catalog import QUERIES  # noqa: E402
from sitesift.session import local_session  # noqa: E402

HEADLINE = [
    "page_summary",
    "capture_gate",
    "url_dedup",
    "metadata_roundtrip",
    "descriptions",
    "images",
    "listing_rows",
    "merged_records",
    "documents_txt",
    "attempt_outcomes",
    "attempt_timeouts",
    "batch_summary",
    "batch_state_recovery",
    "stream_history",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="sitesift-bench")
    times: dict[str, float] = {}
    for name in names:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
