"""Times the headline queries. Prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from levelmap.plans import catalog  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "bars_1h sheet_defaults sheet_static sheet_by_session sheet_asof level_order regime_mode prev_close "
    "session_reset_dom last_bar node_flip_state node_flip_event any_flip node_label zone_clusters zone_counts "
    "zone_entry zone_entry_any zone_entry_intrabar zone_touch_count pin_class pin_break alerts snapshot "
    "annotations stream_bars stream_alerts stream_forming stream_zone_entry"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("levelmap-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        # Call-site capture costs milliseconds for each column built in Python.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, name: str) -> float:
    """Best of three whole runs, from building the plan to the last row."""
    runs = []
    for _ in range(3):
        started = time.perf_counter()
        catalog.queries()[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        runs.append(time.perf_counter() - started)
    return round(min(runs), 3)


def main() -> None:
    spark = session()
    timed(spark, "alerts")  # the first queries of a session pay for class loading
    seconds = {name: timed(spark, name) for name in HEADLINE}
    found = re.search(r"sf([0-9.]+)", FOLDER)
    print(
        json.dumps(
            {
                "metric": "total of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else FOLDER,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
