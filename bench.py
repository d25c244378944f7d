"""Headline workloads, timed: one warm-up, then the median of three runs. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from burnish.operators.profile import profile
from burnish.operators.scale import scale
from check import session
from queries import registered
from queries.registry import table

RUNS = 3


def full_profile(spark, sf_dir):
    """Every part of the profile, run to the end."""
    for part in profile(table(spark, sf_dir, "lineitem"), "l_orderkey").values():
        part.collect()


def standard_scaling(spark, sf_dir):
    return scale(table(spark, sf_dir, "lineitem"), {"__all_numeric__": "standard"}).df


WORKLOADS = {
    "full_profile_lineitem": full_profile,
    "ordered_fill_events": registered()["m6_fill_ffill"],
    "interpolate_events": registered()["m9_fill_interpolate"],
    "subset_dedupe_part": registered()["dd1_keep_first"],
    "frequency_encoding_orders": registered()["e3_frequency"],
    "label_encoding_many_values": registered()["e1_label_many_values"],
    "standard_scaling_lineitem": standard_scaling,
    "robust_scaling_lineitem": registered()["n3_robust"],
    "power_scaling_customer": registered()["n6_power_yeo"],
    "iqr_removal_events": registered()["o2_remove_iqr"],
    "quantile_bins_lineitem": registered()["f7_bin"],
    "date_features_orders": registered()["dt2_year"],
    "tfidf_documents": registered()["x3_tfidf"],
    "quality_gate_lineitem": registered()["v12_quality_gate"],
    "end_to_end_orders": registered()["g1_end_to_end"],
}


def once(run, spark, sf_dir) -> float:
    started = time.perf_counter()
    result = run(spark, sf_dir)
    if result is not None:
        result.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:]
    spark = session(cores, cores)
    times = {}
    for name, run in WORKLOADS.items():
        if wanted and name not in wanted:
            continue
        once(run, spark, sf_dir)
        times[name] = round(statistics.median(once(run, spark, sf_dir) for _ in range(RUNS)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    total = round(sum(times.values()), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
