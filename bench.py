"""Benchmark the headline jobs; prints one JSON line.

The ring-by-ring flood fill (``frontier_assign``) is the alternative to ``nearest_seed`` and is
not a headline job: its cost is one small job per ring, so it grows with the largest distance
on the grid rather than with the data (see README). ``leaderboards_fifteen_pass`` is the test form
of ``leaderboards_all`` and is not timed either.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 2: best of N runs per query, after one warm-up of the session).
Each query is fully executed with the ``noop`` sink (nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from territory_engine.plans import registry  # noqa: E402
from territory_engine.session import get_spark  # noqa: E402

HEADLINE = [
    "claims_fold",                 # Q2: full cooldown fold of every claim
    "claims_fold_coarse",          # Q2 on few keys with long histories
    "leaderboards_all",            # Q3: fifteen rankings in one pass
    "recents_masked",              # Q4
    "territory_view",              # Q6 for every territory
    "user_view",                   # Q7 for every name
    "territory_page",              # Q6 for one territory
    "admission_verdict",           # Q1
    "claims_merge_batches",        # U4 + J8: three incremental upserts
    "incremental_counts",          # Q11
    "nearest_seed",                # J10: nearest facility for every land cell
    "territory_claimant_map",      # Q8
    "division_areas",              # Q9
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus)))
    spark = get_spark(f"local[{cpus}]", parts, app="territory-engine-bench")
    # warm the session (JVM start, first parquet read) outside the timings
    registry.QUERIES["claims_fold"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in HEADLINE:
        best = None
        try:
            for _ in range(repeat):
                t0 = time.perf_counter()
                registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                best = dt if best is None else min(best, dt)
            timings[name] = round(best, 3)
        except Exception as e:  # noqa: BLE001 - report the failure, keep timing the rest
            errors[name] = str(e)[:200]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        **({"errors": errors} if errors else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
