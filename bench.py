"""Wall-clock of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lagcast.registry import QUERIES  # noqa: E402
from lagcast.session import local_session  # noqa: E402

HEADLINE = [
    "prepared_events",
    "history_runs",
    "history_nested_columnar",
    "overlay_recent",
    "board_entries",
    "route_after_stop",
    "xml_condense_day",
    "live_board_merge",
    "empirical_blind_quantiles",
    "empirical_delta_quantiles",
    "bucket_stats",
    "forecast_cards",
    "connection_outcome",
    "itinerary_top5",
    "backtest_scores_grouping_sets",
    "stream_change_fold",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    # One cheap query first, so that starting the JVM is not charged to the others.
    QUERIES["stations"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
