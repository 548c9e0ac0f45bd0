"""Benchmark: wall time of the headline queries.

Runs every registered query on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` (default 8).  Each query is
executed end to end from the parquet tables into Spark's ``noop`` sink (the
whole plan runs, nothing is collected); the reported time is the median of
``$BENCH_REPEAT`` runs (default 3; model queries run once).  Prints ONE JSON
line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT = int(os.environ.get("BENCH_REPEAT", "3"))
ONLY = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
# Forest training dominates its queries; one run each keeps the bench short.
SINGLE_RUN = {"model_training", "feature_importance", "model_reevaluation", "scenario_scores"}


def main() -> None:
    from panelwise.plans.catalog import REGISTRY
    from panelwise.session import local_session

    spark = local_session(CPUS, shuffle_partitions=int(CPUS), app="panelwise-bench")
    from panelwise.plans.registry import prepared_table

    t0 = time.perf_counter()
    prepared_table(spark, SF_DIR)  # derived and written once; later queries read it
    build = round(time.perf_counter() - t0, 3)
    names = ONLY or list(REGISTRY)
    # warm-up: JVM start, class loading, first codegen (not reported)
    REGISTRY["kpi_summary"].build(spark, SF_DIR).write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {} if ONLY else {"prepared_table": build}
    errors: dict[str, str] = {}
    for name in names:
        runs = []
        for _ in range(1 if name in SINGLE_RUN else REPEAT):
            t0 = time.perf_counter()
            try:
                REGISTRY[name].build(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            except Exception as exc:  # noqa: BLE001 - report and continue
                errors[name] = str(exc).splitlines()[0][:200]
                break
            runs.append(time.perf_counter() - t0)
        if runs:
            timings[name] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", SF_DIR)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else SF_DIR,
        "n_queries": len(timings),
        "cpus": CPUS,
        "repeat": REPEAT,
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
