"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query runs once to warm up, then up to three times for the median; a query that has
taken BENCH_BUDGET seconds in all is not repeated further.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from tests.session import local_session
from tidewatch.operators import scoring, spread
from tidewatch.plans import catalog, tables

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
BUDGET = float(os.environ.get("BENCH_BUDGET", "12"))

HEADLINE = """
flag_scores win_sliding win_interpolate scale_standard scale_robust win_avg_rank
agg_roc_auc agg_avg_precision agg_point_adjust agg_threshold_sweep agg_type_metrics score_ecdf
lagged_spearman assign_groups recon_pca mask_importance interpret_nodes graph_gcn_smooth
inject_time_warp inject_spike agg_trial_stats win_running_best src_matrix src_plant_csv stream_panel
""".split()


def one_series(size):
    """All events as a single series, windowed in buckets of ``size`` steps."""

    def run(spark, folder):
        events = tables.table(spark, folder, "events").select(
            F.lit(0).alias("series_id"), "ts", "event_id", F.col("value").alias("x")
        )
        steps = spread.row_index(events, tables.BY, ["ts", "event_id"])
        return scoring.window_mean_error(steps, tables.BY, ["x"], tables.LENGTH, size=size)

    return run


def seconds(run, spark) -> float:
    start = time.perf_counter()
    run(spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    spark = local_session(CPUS, "bench")
    runs = {name: catalog.QUERIES[name] for name in HEADLINE}
    runs |= {"one_series_whole": one_series(10**9), "one_series_buckets": one_series(8192)}
    only = sys.argv[1:]
    took = {}
    for name, run in runs.items():
        if only and name not in only:
            continue
        seconds(run, spark)
        laps = [seconds(run, spark)]
        while len(laps) < RUNS and sum(laps) < BUDGET:
            laps.append(seconds(run, spark))
        took[name] = round(statistics.median(laps), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
