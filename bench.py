"""Times the headline queries on one folder of tables and prints one JSON line.

BENCH_SF_DIR names the folder (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8).  One untimed query
warms up the session; every query computes all its rows once.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from claimloom.plans import catalog  # noqa: E402
from claimloom.session import local_session  # noqa: E402

HEADLINE = (
    "k02_knn", "k07_rerank_hybrid", "p01_chunk", "v06_compare_pages", "v04_diff_versions", "v16_export_rows", "e03_rank_evidence",
    "g03_duration_summary", "g05_scorecard", "d01_dedup_exact", "f07_mine_facts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "claimloom-bench")
    queries = catalog.queries()
    times = {}
    queries["g05_scorecard"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
