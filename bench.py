"""Headline timings: one JSON line. BENCH_SF_DIR (tables), BENCH_CPUS (local cores)."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from flowspark import queries as engine
from flowspark.operators import execute, series, sweep

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TABLES = ("dense_count_series", "stock_replay_record", "stock_snapshots", "final_stock", "conservation_totals", "overdraw_violations", "append_order_violations", "log_digest", "expr_arithmetic", "interp_clamp", "quantum_floor", "partition_fixed_split", "lag_projection", "rolling_sum_ordered", "recurrence_linear_reservoir", "simulate_tier_b", "simulate_tier_c")


def sweep_1000_runs(spark: SparkSession):
    """The published workload's size: 1,000 trials of 2,191 daily steps; here every step also moves water."""
    grid = sweep.sweep(spark, 1000, ("upper", "water", "gain"), F.lit(0.2) + (F.col("id") % 600) / 1000)
    return execute.run(spark, engine.basin(2190), grid)


def published_sweep_1000_runs(spark: SparkSession):
    """The published workload as it is: 1,000 trials of its own model, the rule evaluated at every step, every trial's presence read."""
    model = engine.published_sweep(2190)
    grid = sweep.sweep(spark, 1000, ("basin-00", "water", "release-coefficient"), F.lit(0.2) + (F.col("id") % 600) / 1000)
    done = execute.outcomes(spark, model, grid).where("status = 'completed'")
    return series.ranged_runs(execute.run(spark, model, grid), done, "outgoing", "basin-00", "water", (0, 2190), (0, 2190), 1e-6)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {n: (lambda n=n: engine.QUERIES[n](spark, SF_DIR)) for n in TABLES} | {"sweep_1000_runs": lambda: sweep_1000_runs(spark), "published_sweep_1000_runs": lambda: published_sweep_1000_runs(spark)}
    engine.QUERIES["fact_incoming"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    took = {}
    for name, make in todo.items():
        begun = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begun, 3)
    runs, published = (round(1000 / took[n], 2) for n in ("sweep_1000_runs", "published_sweep_1000_runs"))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR), "sweep_runs_per_second": runs, "published_sweep_runs_per_second": published, "published_sweep_baseline_runs_per_second": 0.846}))


if __name__ == "__main__":
    main()
