"""Exact overlap areas and interior points against scanlines in plain Python."""

from __future__ import annotations

import math
import random

import pytest
from test_spatial import HOLED, RINGS, STAR, TWO_PARTS, box, layer, odd_crossings

from updraft.operators import overlay, spatial
from updraft.operators.filters import BBox


def star(rng, cx, cy, r, n):
    turn = rng.uniform(0, 1)
    return [(cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * (k + turn) / n), cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * (k + turn) / n)) for k in range(n)]


def sides(rings):
    return [(a, b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if a[1] != b[1]]


def at(side, y):
    (xa, ya), (xb, yb) = side
    return xa + (y - ya) * (xb - xa) / (yb - ya)


def shared_area(a, b):
    """Between all corners and crossings the borders are straight and keep their order: trapezoids, added up."""
    ea, eb = sides(a), sides(b)
    ys = {p[1] for ring in (*a, *b) for p in ring}
    for e in ea:
        for f in eb:
            lo, hi = (g(g2(p[1] for p in e), g2(p[1] for p in f)) for g, g2 in ((max, min), (min, max)))
            if lo < hi and (at(e, lo) - at(f, lo)) * (at(e, hi) - at(f, hi)) < 0:
                d1, d2 = at(e, lo) - at(f, lo), at(e, hi) - at(f, hi)
                ys.add(lo + (hi - lo) * d1 / (d1 - d2))
    ys, total = sorted(ys), 0.0
    for lo, hi in zip(ys, ys[1:]):
        mid = (lo + hi) / 2
        xs = [sorted(at(e, mid) for e in es if (e[0][1] > mid) != (e[1][1] > mid)) for es in (ea, eb)]
        spans = [list(zip(x[::2], x[1::2], strict=True)) for x in xs]
        total += (hi - lo) * sum(max(0.0, min(q, s) - max(p, r)) for p, q in spans[0] for r, s in spans[1])
    return total


def areas(spark, a, b):
    edges = [overlay.signed_edges(spatial.region_edges(layer(spark, *shapes))) for shapes in (a, b)]
    return {(r.region_id, r.group_id): r.area_deg2 for r in overlay.overlap_areas(*edges).collect()}


def test_areas_of_any_two_shapes(spark):
    rng = random.Random(8)
    a = [[star(rng, rng.uniform(5, 7), rng.uniform(45, 47), rng.uniform(0.02, 2), rng.randrange(3, 15))] for _ in range(12)]
    a += [[ring[::-1] for ring in shape] for shape in ([STAR], HOLED, TWO_PARTS)] + [HOLED, [*HOLED, box(8.8, 45.8, 9.2, 46.2)]]
    b = [[STAR], HOLED, TWO_PARTS, [box(4, 44, 13, 48)], [box(6, 45.9, 6.01, 45.91)], [box(40, 10, 41, 11)]]
    got = areas(spark, a, b)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            assert got.get((i, j), 0.0) == pytest.approx(shared_area(x, y), abs=1e-9), (i, j)
    assert len(got) > 20


def test_area_of_a_region_does_not_depend_on_ring_directions(spark):
    shapes = [HOLED, [HOLED[0], HOLED[1][::-1]], [HOLED[1], HOLED[0][::-1]], TWO_PARTS]
    found = overlay.region_areas(overlay.signed_edges(spatial.region_edges(layer(spark, *shapes))))
    got = {r.region_id: r.area_deg2 for r in found.collect()}
    assert [got[i] for i in range(4)] == pytest.approx([3.36, 3.36, 3.36, 0.25 + 0.63], abs=1e-12)


def groups(spark):
    shapes = [[box(0, 0, 10, 10)], [box(9, 0, 20, 10)], [[(30, 0), (40, 0), (30, 10)]]]
    return layer(spark, *shapes).selectExpr("*", "concat('g', region_id) AS name")


def test_regions_far_below_a_cell_get_their_group(spark):
    tiny = [[box(3.001, 3.001, 3.0015, 3.0015)], [box(9.0, 1, 9.001, 1.0001)], [[(36.0, 1.0), (36.00001, 1.0), (36.0, 1.00001)]], [box(25, 1, 25.0001, 1.0001)]]
    basins = layer(spark, *tiny)
    for method in ("largest_overlap", "centroid"):
        got = {r.region_id: r.name for r in spatial.assign_basins(basins, groups(spark), ["name"], method).collect()}
        assert got == {0: "g0", 1: "g0", 2: "g2", 3: ""}, method  # equal shares: the first in layer order


def test_the_larger_share_decides_however_small_the_lead(spark):
    basins = layer(spark, [box(8.5, 1, 10.50001, 2)], [box(8.49999, 1, 10.5, 2)])
    got = {r.region_id: r.name for r in spatial.assign_largest_overlap(basins, groups(spark), ["name"]).collect()}
    assert got == {0: "g1", 1: "g0"}


def test_share_in_a_box_is_exact(spark):
    regions = layer(spark, [[(0, 0), (2, 0), (0, 2)]], HOLED, [box(50, 0, 51, 1)])
    kept = spatial.inside_bbox(regions, BBox(0.0, 0.0, 1.0, 1.0), 0.5).collect()
    assert [(r.region_id, r.overlap_frac) for r in kept] == [(0, pytest.approx(0.5, abs=1e-12))]
    assert [r.region_id for r in spatial.inside_bbox(regions, BBox(-1.0, -1.0, 60.0, 60.0), 1.0).orderBy("region_id").collect()] == [0, 1, 2]


def test_interior_points_are_inside(spark):
    rng = random.Random(4)
    horseshoe = [[(0, 0), (9, 0), (9, 9), (6, 9), (6, 1), (3, 1), (3, 9), (0, 9)]]
    shapes = [[STAR], HOLED, TWO_PARTS, horseshoe, [box(1, 1, 1.00001, 1.00001)]]
    shapes += [[star(rng, 7, 46, 10 ** rng.uniform(-4, 0.3), rng.randrange(3, 30))] for _ in range(40)]
    got = {r.region_id: (r.lon, r.lat) for r in spatial.representative_points(layer(spark, *shapes)).collect()}
    assert len(got) == len(shapes) and all(odd_crossings(shapes[i], *p) for i, p in got.items())
    assert got[1] == pytest.approx((8.3, 46.2)) or got[1] == pytest.approx((9.7, 46.2)) or odd_crossings(HOLED, *got[1])
    assert got[4] == pytest.approx((1.000005, 1.000005))


def test_no_area_no_point(spark):
    flat = layer(spark, [[(0, 0), (1, 0), (2, 0)]], [[(0, 0), (1, 1), (0, 0)]])
    assert spatial.representative_points(flat).collect() == []
    assert spatial.representative_points(spark.createDataFrame([], f"region_id INT, ord INT, rings {RINGS}")).collect() == []
