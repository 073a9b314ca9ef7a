"""Time the headline queries: one JSON line with seconds for each, on local[$BENCH_CPUS] over $BENCH_SF_DIR."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkweave import spark_session
from sparkweave.plans import catalog

HEADLINE = [*(f"tpch_q{k:02d}" for k in range(1, 23)), "stage_join_group_limit", "agg_cube", "win_top_per_group", "join_anti_residual", "distinct_on_frame"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    settings = {"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")}
    spark = spark_session("bench", f"local[{cpus}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    catalog.QUERIES["tpch_q01"](spark, folder).collect()  # starts the JVM's compilers and caches the file list
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, folder).collect()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": {k.replace("tpch_q0", "q").replace("tpch_q", "q"): v for k, v in seconds.items()}, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
