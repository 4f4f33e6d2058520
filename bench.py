"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from panelspark.queries import all_queries
from panelspark.session import local_session

HEADLINE = [
    "w1_lags_sparse",
    "w2_percentile_rank",
    "w2_percentile_rank_lines",
    "w4_interpolate_linear",
    "w8_group_mean_fill",
    "j13_asof_backfill",
    "a14_binned_stats",
    "a19_stability_matrix",
    "g4_pair_table",
    "g6_spatial_correlation",
    "i5_bloc_roll_up",
    "o7_kalman_level",
    "r2_growth_projection",
    "v6_synthetic_report",
    "v12_cleaned_events",
    "m9_linear_regression",
    "m18_kendall",
    "x1_permutation_importance",
    "m13_nested_ensemble",
    "m20_backtest_grid",
    "v12_assembled_panel",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="panelspark-bench")
    queries, times = all_queries(), {}
    queries["q1_row_rules"](spark, sf_dir).collect()  # start the engine
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
