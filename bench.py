"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion with the `noop` sink (every row computed,
nothing collected). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewater.plans import catalog  # noqa: E402
from tidewater.session import get_session  # noqa: E402

HEADLINE = [
    "a1_port_visits",        # spatial grid join + sessionizing
    "l1_voyages",            # visits -> labels -> voyages with ping counts (flagship)
    "j3_current_port",       # as-of labelling of every ping
    "p9_training_set",       # features: distances, rolling speed, lane deviation, label
    "j9_cell_weather",       # weather enrichment joins
    "a16_correlations",      # analysis aggregate
    "w9_hours_in_port",      # second port-call method
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus), app="tidewater-bench")
    # warm-up: JVM start, class loading and code generation are not query time
    catalog.QUERIES["p2_slow_pings"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
