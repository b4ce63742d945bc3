"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of local threads.  Every query is run to
a ``noop`` sink, so all rows are computed and none are collected; staged tables it writes while it
is built count as well.  The best of BENCH_RUNS runs (default 2) is reported.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from citylens.catalog import QUERIES  # noqa: E402
from citylens.session import clear_stages, get_session  # noqa: E402

HEADLINE = [
    "report_subway_flow", "report_bike_flow", "report_bike_zones", "report_stop_boardings", "report_zone_months",
    "report_injury_summary", "report_injury_yearly", "report_distinct_crashes", "report_located_injuries",
    "report_taxi_crashes", "report_air_completeness", "report_air_hourly", "report_air_monthly", "report_response_times",
    "report_traffic_daily", "report_traffic_hourly", "report_traffic_pages", "geo_nearest", "join_point_within",
    "join_dwithin", "win_min_qualify", "dedupe_keys", "agg_subtotals", "src_html_table", "ingest_insert_new", "ingest_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "citylens-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=tempfile.mkdtemp(prefix="citylens-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - start
            best = taken if best is None else min(best, taken)
        seconds[name] = round(best, 3)
    clear_stages(spark)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    result = {"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
