"""Receiver coverage and observed skill on hand-made rows."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from updraft.operators import coverage, scores
from updraft.sources.beacons import heard_by

PARSED = "kind string, source_id string, raw string, ts_recv timestamp, lat double, lon double"
START = dt.datetime(2024, 6, 1, 10)


def packet(second, receiver, lat, lon, sender="FLR1"):
    return ("position", sender, f"{sender}>APRS,qAS,{receiver}:/x", START + dt.timedelta(seconds=second), lat, lon)


def beacon(second, receiver, lat, lon):
    return ("receiver", receiver, f"{receiver}>APRS,TCPIP*,qAC,SERVER:/x", START + dt.timedelta(seconds=second), lat, lon)


def rows_of(spark, rows, **options):
    out = coverage.receiver_coverage(spark.createDataFrame(rows, PARSED), **options)
    return {(r.receiver, r.window_start_s, r.sector): (r.packets, r.range_km) for r in out.collect()}


def test_last_station_of_the_path(spark):
    lines = ["FLR1>APRS,qAS,RX7:/1:2>3,4", "FLR1>APRS:/1", "# comment"]
    found = spark.createDataFrame([(x,) for x in lines], "raw string").select(heard_by(F.col("raw"))).collect()
    assert [r[0] for r in found] == ["RX7", "APRS", "# comment"]


def test_ranges_by_sector_and_silent_sectors(spark):
    at = int(START.replace(tzinfo=dt.UTC).timestamp())
    found = rows_of(
        spark,
        [
            packet(-1, "A", 46.0, 8.0),  # before the first beacon
            beacon(0, "A", 46.0, 8.0),
            packet(0, "A", 46.5, 8.1),  # at the time of the beacon
            packet(5, "A", 46.2, 8.01),
            packet(3700, "A", 45.0, 7.99),  # the beacon of the hour before holds
            beacon(3800, "A", 45.0, 8.0),  # the receiver has moved
            packet(3900, "A", 45.0, 9.0),
            beacon(0, "B", 47.0, 9.0),  # listens and hears nothing
        ],
    )
    assert found[("A", at - 3600, None)] == (1, None)
    assert [found[("A", at - 3600, s)] for s in range(8)] == [(0, 0.0)] * 8
    assert found[("A", at, 0)][0] == 2 and found[("A", at, 0)][1] == pytest.approx(56.1, abs=0.2)
    assert found[("A", at + 3600, 4)] == (1, pytest.approx(111.2, abs=0.1))
    assert found[("A", at + 3600, 1)] == (1, pytest.approx(78.6, abs=0.1))
    assert [found[("B", at, s)] for s in range(8)] == [(0, 0.0)] * 8
    assert ("B", at + 3600, 0) not in found


def test_places_equal_a_walk_in_time_order(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        second, receiver = rng.randrange(20_000), f"R{rng.choice('aaaaab')}"
        make = beacon if rng.random() < 0.1 else packet
        rows.append(make(second, receiver, 46 + rng.randrange(100) / 100, 8 + rng.randrange(100) / 100))
    events = coverage.heard_events(spark.createDataFrame(rows, PARSED))
    found = coverage.placed_receptions(events).select("receiver", "ts_recv", "lat", "lon", "rx_lat", "rx_lon").collect()
    places, want = {}, []
    for kind, source, raw, ts, lat, lon in sorted(rows, key=lambda r: (r[3], r[0] != "receiver", r[4], r[5])):
        if kind == "receiver":
            places[source] = (lat, lon)
        else:
            receiver = raw.split(":")[0].split(",")[-1]
            want.append((receiver, ts, lat, lon, *places.get(receiver, (None, None))))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found)


def test_rows_without_receiver_place_or_time_are_left_out(spark):
    lost = [
        ("position", "F", None, START, 46.0, 8.0), ("receiver", None, "x", START, 46.0, 8.0), ("status", "A", "A>B,C:>", START, None, None),
        ("position", "F", "F>A,B:/", None, 46.0, 8.0), ("receiver", "A", "A>B:/", START, None, 8.0), (None, None, None, None, None, None),
    ]
    assert rows_of(spark, lost) == {}
    assert rows_of(spark, lost[:0]) == {}


def test_observed_skill_pairs_bins_with_their_hour(spark):
    bins = spark.createDataFrame(
        [(1, 0, 36_000, 2.0, 2000.0), (1, 0, 37_800, 3.0, 2500.0), (1, 0, 39_600, 1.0, None), (2, 0, 36_000, 1.0, 1000.0), (None, 0, 36_000, 1.0, 1.0)],
        "region_id int, day int, bin_start_s long, climb_median_ms double, top_max_m double",
    )
    series = spark.createDataFrame(
        [(1, 6, 4, 2100.0, 2.5), (1, 9, 1, 2300.0, 3.5), (1, 6, 5, 1500.0, 1.0), (3, 6, 4, 1.0, 1.0)],
        "region_id int, init_h int, lead_h int, z_top_m double, w_star_ms double",
    )
    found = {(r.region_id, r.valid_h): r for r in scores.observed_skill(bins, series, min_sample=3).collect()}
    assert set(found) == {(1, 10.0), (1, 11.0)}
    ten, eleven = found[(1, 10.0)], found[(1, 11.0)]
    assert (ten.n, ten.enough, eleven.n, eleven.enough) == (4, True, 1, False)
    assert ten.climb_bias_ms == pytest.approx(0.5) and ten.climb_rmse_ms == pytest.approx(math.sqrt((0.25 + 2.25 + 0.25 + 0.25) / 4))
    assert ten.top_bias_m == pytest.approx(-50.0)
    assert eleven.climb_bias_ms == 0.0 and eleven.top_bias_m is None
