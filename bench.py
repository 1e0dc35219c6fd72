"""Time the headline queries and print one JSON line.

``whole_run_sec`` times a complete audit from the portfolio on, every table written
and indexes included. For the headline queries, the portfolio, the thresholds and the
polygon and grid indexes are inputs and are prepared before timing. Every query then starts from the stored tables of
the step before it, as in a run, and is timed to the last row of its result.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tivlens.registry.spark_queries import QUERIES  # noqa: E402
from tivlens.registry.workspace import workspace  # noqa: E402
from tivlens.session import local_session  # noqa: E402

HEADLINES = [
    "e01_density_threshold", "d40_detect_all", "i04_precision_recall", "m02_tiv_percentile",
    "m05_enriched_findings", "m11_scores", "t14_cleansed", "s02_point_in_polygon",
    "s04_nearest_point", "u02_dirty_accumulation", "u04_fallback_accumulation",
    "u09_sensitivity", "u16_impact_summary", "l04_scenario_summary", "j00_selection",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    w = workspace(spark, sf_dir)
    rows = w.marked.count()
    # a whole run first, on a session that has computed nothing but the portfolio
    start = time.perf_counter()
    QUERIES["audit_run"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    whole_run = round(time.perf_counter() - start, 3)
    w.references()
    # stored results of earlier steps that later queries read
    for table in ("flags", "findings", "concentration", "scores", "cleansed", "placed", "dirty_points",
                  "sensitivity"):
        getattr(w, table)
    w.grid
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "portfolio_rows": rows,
        "cpus": cpus, "whole_run_sec": whole_run,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
