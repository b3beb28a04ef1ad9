"""Headline timings: one JSON line on stdout.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS``
(default 8). Each query runs once to warm up and is timed on its second run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from updraft import catalog  # noqa: E402
from updraft.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_thermals",
    "t1_receiver_consensus",
    "t2_spike_reject",
    "t6_assemble_tracks",
    "t12_detect_phases",
    "s3_parse_beacons",
    "j1_assign_region",
    "j8_watchlist_positions",
    "a1_hourly_activity",
    "a3_phase_summary",
    "j16_overlay_phases_on_track",
    "flagship_from_log",
    "x5_stream_hourly_activity",
    "e2_regional_spread",
    "g1_region_mean",
    "g3_surface_series",
    "g10_spatial_max_series",
    "g11_coverage",
    "g13_gate_decision",
    "h3_mixed_layer_evolution",
    "r2_area_height_distribution",
    "r8_pass_height",
    "m2_has_successful_record",
    "b1_job_state",
]


def timed(spark, fn, sf_dir: str) -> float:
    start = time.perf_counter()
    # The no-op sink computes every row and column without moving them anywhere.
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        timed(spark, queries[name], sf_dir)
        seconds[name] = round(timed(spark, queries[name], sf_dir), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
