"""Times the headline queries and prints one JSON line.

The tables come from $BENCH_SF_DIR, the cores from $BENCH_CPUS.  A query's time is that of
writing its whole result to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import time

from tramline.plans import catalogue
from tramline.session import local_session

HEADLINE = (
    "fares_page", "fare_at", "line_details", "stop_lines", "poi_counts", "itinerary_map", "training_stats", "ping_headings", "smooth_speeds", "stop_passages",
    "bus_pings", "poi_stop_pairs", "stop_sequence", "poi_nearest_stop", "route_match", "next_stops", "confirmed_routes", "upsert_pois", "train_positions", "stream_windows",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    queries["modes"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(os.path.basename(sf.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
