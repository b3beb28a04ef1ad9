from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from updraft.functions.geo import EARTH_RADIUS_M, signed_turn
from updraft.operators import activity, phases, tracks

SCHEMA = "day BIGINT, source_id STRING, aircraft_type INT, t_s BIGINT, lat DOUBLE, lon DOUBLE, alt_m DOUBLE"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def dist(a, b):
    """Great-circle distance in metres between two fixes (t, lat, lon, alt)."""
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


def keep_in_sequence(fixes, vmax=70.0, cmax=15.0, passes=2):
    """Jump rejection walked fix by fix."""
    for _ in range(passes):
        if len(fixes) < 3:
            return fixes
        kept = [fixes[0]]
        for here, ahead in zip(fixes[1:-1], fixes[2:]):
            fast, steep = [], []
            for a, b in ((kept[-1], here), (here, ahead)):
                seconds = abs(b[0] - a[0]) or 1.0
                fast.append(dist(a, b) / seconds > vmax)
                steep.append(abs(b[3] - a[3]) / seconds > cmax)
            if not (all(fast) or all(steep)):
                kept.append(here)
        fixes = [*kept, fixes[-1]]
    return fixes


def random_track(rng, n):
    t, lat, lon, alt, out = 0, 47.0, 11.0, 1000.0, []
    for _ in range(n):
        t += rng.choice([1, 2, 4, 9])
        lat += rng.uniform(-2e-4, 2e-4)
        lon += rng.uniform(-2e-4, 2e-4)
        alt += rng.uniform(-6, 6)
        jump = rng.random()
        out.append((t, lat + (0.3 if jump < 0.12 else 0.0), lon, alt + (400 if 0.12 < jump < 0.22 else 0.0)))
    return out


def test_consensus_takes_the_median_of_the_receivers(spark):
    rows = [(0, "A", 1, 5, 47.0, 11.0, 1000.0), (0, "A", 1, 5, 47.01, 11.01, 1005.0), (0, "A", 1, 5, 47.9, 11.9, 3000.0), (0, "A", 1, 4, 46.0, 10.0, 900.0)]
    out = tracks.receiver_consensus(frame(spark, rows)).orderBy("t_s").collect()
    assert [(r.t_s, r.lat, r.lon, r.alt_m) for r in out] == [(4, 46.0, 10.0, 900.0), (5, 47.01, 11.01, 1005.0)]


def test_one_jump_of_ten_fixes_goes_and_clean_tracks_stay(spark):
    clean = [(0, "clean", 1, 4 * i, 47.0 + i * 1e-4, 11.0, 1000.0 + i) for i in range(10)]
    jumpy = [(0, "jumpy", 1, r[3], r[4] + (1.5 if i == 5 else 0), r[5], r[6]) for i, r in enumerate(clean)]
    out = tracks.spike_reject(frame(spark, clean + jumpy)).groupBy("source_id").count()
    assert {r.source_id: r["count"] for r in out.collect()} == {"clean": 10, "jumpy": 9}


def test_spike_rejection_equals_the_sequential_walk(spark):
    rng = random.Random(7)
    sources = {f"s{i}": random_track(rng, rng.choice([1, 2, 3, 8, 40])) for i in range(150)}
    # One long stretch where nearly every fix is suspect.
    sources["wild"] = [(2 * i, 47.0 + (i % 3) * 0.4, 11.0, 1000.0 + (i % 2) * 300) for i in range(300)]
    rows = [(0, s, 1, *f) for s, fixes in sources.items() for f in fixes]
    got = {}
    for r in tracks.spike_reject(frame(spark, rows)).collect():
        got.setdefault(r.source_id, []).append(r.t_s)
    want = {s: [f[0] for f in keep_in_sequence(fixes)] for s, fixes in sources.items()}
    assert {s: sorted(v) for s, v in got.items()} == want
    assert sum(map(len, want.values())) < len(rows)


def test_min_fixes_counts_per_day(spark):
    rows = [(d, "A", 1, i, 47.0, 11.0, 1000.0) for d, n in ((0, 3), (1, 5)) for i in range(n)]
    assert [r.day for r in tracks.min_fixes(frame(spark, rows), 4).select("day").distinct().collect()] == [1]


def islands_in_sequence(flags, gap=20):
    """Runs of true flags closed by a late enough false one: (first, last) times."""
    runs, start, last = [], None, None
    for t, on in flags:
        if on:
            start, last = (t if start is None else start), t
        elif start is not None and t - last > gap:
            runs.append((start, last))
            start = last = None
    return runs + ([(start, last)] if start is not None else [])


def test_phase_islands_equal_the_sequential_scan(spark):
    rng, rows, want = random.Random(3), [], {}
    for i in range(200):
        t, flags = 0, []
        for _ in range(rng.randint(1, 40)):
            t += rng.choice([1, 4, 9, 15, 60])
            flags.append((t, rng.random() < 0.5))
        want[f"s{i}"] = islands_in_sequence(flags)
        rows += [(0, f"s{i}", t, on) for t, on in flags]
    flagged = spark.createDataFrame(rows, "day BIGINT, source_id STRING, t_s BIGINT, circling BOOLEAN")
    spans = phases.phase_islands(flagged).select("source_id", "phase_start_s", "phase_end_s").distinct().collect()
    got = {s: [] for s in want}
    for r in sorted(spans, key=lambda r: r.phase_start_s):
        got[r.source_id].append((r.phase_start_s, r.phase_end_s))
    assert got == want


def circling_track(spacing, n, climb=2.0, period=20.0):
    return [
        (0, "A", 1, spacing * i, 47.0 + 0.0007 * math.sin(2 * math.pi * spacing * i / period),
         11.0 + 0.001 * math.cos(2 * math.pi * spacing * i / period), 1000.0 + climb * spacing * i)
        for i in range(n)
    ]


def test_dense_circling_is_a_measured_phase(spark):
    (phase,) = phases.detect_phases(frame(spark, circling_track(4, 80))).collect()
    assert phase.method == "turn" and phase.n_turns > 10
    assert phase.climb_rate_ms == pytest.approx(2.0, abs=1e-6)


def test_sparse_circling_is_found_by_its_footprint(spark):
    (phase,) = phases.detect_phases(frame(spark, circling_track(12, 40, period=19.0))).collect()
    assert phase.method == "confined"
    assert phase.n_turns == pytest.approx(phase.duration_s / 20.0)


def test_straight_flight_tow_and_short_tracks_give_nothing(spark):
    straight = [(0, "S", 1, 4 * i, 47.0 + 0.002 * i, 11.0, 1500.0) for i in range(100)]
    tow = [(0, "T", *r[2:]) for r in circling_track(4, 80, climb=9.0)]
    short = [(0, "U", *r[2:]) for r in circling_track(4, 4)]
    assert phases.detect_phases(frame(spark, straight + tow + short)).count() == 0


def test_confinement_matches_numpy(spark):
    rng = random.Random(11)
    fixes, t, lat, lon = [], 0, 47.0, 11.0
    for _ in range(120):
        t += rng.choice([3, 5, 20])
        lat += rng.uniform(-2e-3, 2e-3)
        lon += rng.uniform(-2e-3, 2e-3)
        fixes.append((t, lat, lon))
    arr = np.array(fixes)
    x = EARTH_RADIUS_M * np.radians(arr[:, 2]) * np.cos(np.radians(arr[:, 1].mean()))
    y = EARTH_RADIUS_M * np.radians(arr[:, 1])
    want = []
    for i in range(len(arr)):
        near = (arr[:, 0] >= arr[i, 0] - 120) & (np.arange(len(arr)) <= i)
        far = np.hypot(x[near] - x[near].mean(), y[near] - y[near].mean()).max()
        want.append(bool(near.sum() >= 6 and far <= 400))
    rows = [(0, "A", 1, *f, 1000.0) for f in fixes]
    got = phases.rolling_confined(frame(spark, rows)).orderBy("t_s").select("confined").collect()
    assert [r.confined for r in got] == want and any(want) and not all(want)


def test_overlay_marks_the_fixes_of_a_phase(spark):
    fixes = frame(spark, [(0, "A", 1, t, 47.0, 11.0, 1000.0) for t in (0, 10, 20, 30)])
    phase = spark.createDataFrame([(0, "A", 10, 20)], "day BIGINT, source_id STRING, t_start_s BIGINT, t_end_s BIGINT")
    got = activity.overlay_phases_on_track(fixes, phase).orderBy("t_s").select("phase_start_s").collect()
    assert [r.phase_start_s for r in got] == [None, 10, 10, None]


def test_windows_share_the_track_shuffle(spark):
    """From the consensus on, everything runs on one hash partitioning by track."""
    fixes = frame(spark, circling_track(4, 80)).repartition("day", "source_id")
    plan = phases.detect_phases(tracks.spike_reject(fixes))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan


def test_cap_aircraft_keeps_the_first_seen(spark):
    rows = [(0, s, 1, t, 47.0, 11.0, 1000.0) for s, t in (("late", 9), ("first", 1), ("second", 2), ("first", 50))]
    got = tracks.cap_aircraft(frame(spark, rows), 2, ["t_s"]).agg(F.sort_array(F.collect_list("source_id"))).first()[0]
    assert got == ["first", "first", "second"]


def test_turns_round_as_in_the_sql(spark):
    pairs = [(0.0, 38.50609334908057), (0.0, 40.60368665555819), (270.0, 180.0), (350.0, 10.0), (10.0, 350.0), (0.0, 180.0)]
    rows = spark.createDataFrame(pairs, "a DOUBLE, b DOUBLE").select("a", "b", signed_turn(F.col("a"), F.col("b")).alias("turn"))
    want = {(a, b): math.fmod(math.fmod(b - a + 180, 360) + 360, 360) - 180 for a, b in pairs}
    assert {(r.a, r.b): r.turn for r in rows.collect()} == want
    assert want[pairs[0]] == 38.50609334908063
