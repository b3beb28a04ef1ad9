from __future__ import annotations

import datetime as dt
import math
import os
import random

import check
import pytest

from updraft import catalog
from updraft.operators import spatial
from updraft.operators.filters import BBox, enclosing_circle

RINGS = "ARRAY<ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>>"


def layer(spark, *regions):
    rows = [(i, i, [[tuple(map(float, p)) for p in [*ring, ring[0]]] for ring in rings]) for i, rings in enumerate(regions)]
    return spark.createDataFrame(rows, f"region_id INT, ord INT, rings {RINGS}")


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def odd_crossings(rings, x, y):
    """Point in polygon by angle-free ray casting, plain Python."""
    inside = False
    for ring in rings:
        for (xa, ya), (xb, yb) in zip(ring, [*ring[1:], ring[0]]):
            if (ya > y) != (yb > y) and x < (xb - xa) * (y - ya) / (yb - ya) + xa:
                inside = not inside
    return inside


STAR = [(6 + (1.4 if k % 2 else 0.5) * math.cos(k * math.pi / 7), 46 + (1.4 if k % 2 else 0.5) * math.sin(k * math.pi / 7)) for k in range(14)]
HOLED = [box(8, 45, 10, 47), box(8.6, 45.6, 9.4, 46.4)]
TWO_PARTS = [box(11, 45, 11.5, 45.5), box(12, 46, 12.7, 46.9)]


@pytest.mark.parametrize("cell", [0.07, 0.25, 3.0])
def test_region_join_equals_ray_casting(spark, cell):
    shapes = [[STAR], HOLED, TWO_PARTS, [box(5.5, 45.5, 8.5, 46.5)]]
    rng = random.Random(5)
    pts = [(i, rng.uniform(4, 13), rng.uniform(44, 48)) for i in range(3000)]
    points = spark.createDataFrame(pts, "pid INT, lon DOUBLE, lat DOUBLE")
    got = {r.pid: r.region_id for r in spatial.assign_region(points, layer(spark, *shapes), cell_deg=cell).collect()}
    want = {p: next((i for i, s in enumerate(shapes) if odd_crossings(s, x, y)), None) for p, x, y in pts}
    assert got == want and len(set(want.values())) == 5
    both = spatial.points_in_regions(points, layer(spark, *shapes), cell_deg=cell).count()
    assert both == sum(odd_crossings(s, x, y) for _, x, y in pts for s in shapes)


def test_shared_border_belongs_to_one_region(spark):
    regions = layer(spark, [box(0, 0, 1, 1)], [box(1, 0, 2, 1)])
    points = spark.createDataFrame([(1.0, 0.5), (0.0, 0.0), (2.0, 0.5)], "lon DOUBLE, lat DOUBLE")
    got = [r.region_id for r in spatial.assign_region(points, regions).orderBy("lon").collect()]
    assert got == [0, 1, None]


def test_points_outside_stay_when_asked(spark):
    regions = layer(spark, [box(0, 0, 1, 1)], [box(0, 0.5, 1, 2)])
    points = spark.createDataFrame([(0.5, 0.7), (0.5, 0.2), (0.5, 2.0), (None, 0.7)], "lon DOUBLE, lat DOUBLE")
    got = [(r.lon, r.lat, r.region_id) for r in spatial.points_in_regions(points, regions, outside=True).collect()]
    assert sorted(got, key=str) == [(0.5, 0.2, 0), (0.5, 0.7, 0), (0.5, 0.7, 1), (0.5, 2.0, None), (None, 0.7, None)]


def test_message_rate_counts_a_packet_in_each_of_two_regions_that_overlap(spark, tmp_path):
    # At 46.8 degrees, where one row of region boxes ends a digit above the start of the next.
    rows = [(216_000, dt.datetime(2024, 1, 1, 9, 0), 7), (216_001, dt.datetime(2024, 1, 1, 9, 1), 8)]
    spark.createDataFrame(rows, "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG").coalesce(1).write.parquet(f"{tmp_path}/one")
    os.link(next((tmp_path / "one").glob("*.parquet")), tmp_path / "events.parquet")
    os.symlink("/root/testdata/sf0.001/nation.parquet", tmp_path / "nation.parquet")
    verdict, _, n = check.compare(spark, check.connect(str(tmp_path)), "e7_message_rate", str(tmp_path), *catalog.load())
    assert verdict == "ok" and n == 2, verdict


def test_covered_cells_leave_holes_open(spark):
    area = spatial.covered_cells(layer(spark, HOLED), 0.1).count() * 0.01
    assert area == pytest.approx(4 - 0.64, abs=0.1)


def test_inside_bbox_drops_a_quarter_and_keeps_six_sevenths(spark):
    regions = layer(spark, [box(-3, 0, 1, 1)], [box(-1, 0, 6, 1)], [box(20, 0, 21, 1)])
    kept = spatial.inside_bbox(regions, BBox(0.0, -1.0, 10.0, 2.0), 0.5).collect()
    assert [(r.region_id, round(r.overlap_frac, 2)) for r in kept] == [(1, 0.86)]


def test_neighbours_touch_nearly_touch_or_nest(spark):
    regions = layer(
        spark, [box(0, 0, 1, 1)], [box(1, 0, 2, 1)], [box(2.004, 0, 3, 1)], [box(3.02, 0, 4, 1)],
        [box(0.3, 0.3, 0.6, 0.6)], [[(1.0, 1.0), (1.5, 1.6), (0.9, 1.9)]],
    )
    got = {(r.region_a, r.region_b) for r in spatial.neighbour_pairs(regions).collect()}
    assert got == {(0, 1), (1, 2), (0, 4), (0, 5), (1, 5)}


def test_unknown_assignment_method_is_an_error(spark):
    with pytest.raises(ValueError):
        spatial.assign_basins(None, None, [], "nearest")


def test_points_are_not_shuffled_for_the_region_join(spark):
    points = spark.range(1000).selectExpr("id", "5 + id * 0.01 AS lon", "46.0D AS lat")
    plan = spatial.assign_region(points, layer(spark, [STAR]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_boxes_and_circle():
    with pytest.raises(ValueError):
        BBox(2.0, 0.0, 1.0, 1.0)
    lat, lon, radius = enclosing_circle(BBox(8.0, 45.0, 10.0, 47.0), margin_km=0.0)
    assert (lat, lon) == (46.0, 9.0) and radius == math.ceil(math.hypot(111.0, 111.0 * math.cos(math.radians(46))))
