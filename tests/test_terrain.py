from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from updraft.operators import components, terrain


def pixels(spark, values, region=0, area=1.0):
    return spark.createDataFrame([(region, float(v), area) for v in values], "region_id INT, elev_m DOUBLE, pixel_area_m2 DOUBLE")


def bins(df):
    return [(r.z_bottom_m, r.s_g_m2, r.v_a_m3) for r in terrain.area_height_distribution(df).orderBy("z_bottom_m").collect()]


def test_step_terrain_fills_two_bins_of_half_the_area(spark):
    got = bins(pixels(spark, [1000.0] * 50 + [1999.0] * 50))
    assert [b for b in got if b[1] > 0] == [(1000.0, 50.0, 2500.0), (1900.0, 50.0, 7500.0)]
    volumes = [b[2] for b in got]
    assert len(got) == 10 and volumes == sorted(volumes) and sum(b[1] for b in got) == 100.0


def test_top_edge_closes_the_last_bin_and_flat_terrain_keeps_one(spark):
    assert [b[:2] for b in bins(pixels(spark, [550.0, 700.0]))] == [(500.0, 1.0), (600.0, 1.0)]
    assert [b[:2] for b in bins(pixels(spark, [500.0, 500.0]))] == [(500.0, 2.0)]


def test_small_band_joins_the_largest(spark):
    px = pixels(spark, [700.0] * 30 + [1000.0] * 900 + [1800.0] * 100, area=1e5)
    regions = spark.createDataFrame([(0, 103.0, True), (9, 5.0, False)], "region_id INT, area_km2 DOUBLE, candidate BOOLEAN")
    segments, band_map = terrain.elevation_bands(px, regions, 5.0)
    got = {r.segment_id: (round(r.area_km2, 6), round(r.area_total_km2, 6)) for r in segments.collect()}
    assert got == {"0_voralpen": (90.0, 93.0), "0_hochgebirge": (10.0, 10.0), "9": (5.0, 5.0)}
    assert terrain.label_pixels(px, band_map).where("segment_id = '0_voralpen'").count() == 930


def test_tiles_of_bounds(spark):
    bounds = spark.createDataFrame([(-0.5, 46.2, 1.0, 47.0)], "min_lon DOUBLE, min_lat DOUBLE, max_lon DOUBLE, max_lat DOUBLE")
    got = sorted(r.tile for r in terrain.tile_cover(bounds).collect())
    assert got == ["Copernicus_DSM_COG_10_N46_00_E000_00_DEM", "Copernicus_DSM_COG_10_N46_00_W001_00_DEM"]


def flood(cells):
    """Connected parts of a cell set, by direct neighbours."""
    left, parts = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            part.add((x, y))
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        parts.append(part)
    return parts


def test_largest_component_equals_flood_fill(spark):
    rng = random.Random(4)
    w = h = 24
    mask = {(x, y) for x in range(w) for y in range(h) if rng.random() < 0.55}
    cells = spark.createDataFrame([(x, y, 1500.0 if (x, y) in mask else 200.0) for x in range(w) for y in range(h)], "x LONG, y LONG, elev_m DOUBLE")
    frame = (0, 0, w - 1, h - 1)

    def filled(area):
        everything = {(x, y) for x in range(w) for y in range(h)}
        shut = [p for p in flood(everything - area) if not any(x in (0, w - 1) or y in (0, h - 1) for x, y in p)]
        return area.union(*shut)

    want = filled(max(flood(filled(mask)), key=len))
    got = {(r.x, r.y) for r in components.high_terrain_component(cells, frame, 1000.0, 0).collect()}
    assert got == want


def test_long_chain_settles_in_few_rounds(spark):
    edges = spark.range(2000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = components.connected_components(edges).select("component").distinct().collect()
    assert [r.component for r in got] == [0]


def test_closing_bridges_a_gap_but_erodes_the_rim(spark):
    mask = spark.createDataFrame([(x, y) for y in range(5) for x in range(11) if x != 5], "x LONG, y LONG")
    got = {(r.x, r.y) for r in components.close_mask(mask, (0, 0, 10, 4), 1).collect()}
    assert (5, 2) in got and (0, 2) not in got


@pytest.mark.parametrize("area,label", [(99.9, "small"), (100.0, "small_alpine"), (500.0, "liechti"), (3000.0, "huge")])
def test_size_classes_are_half_open(spark, area, label):
    assert spark.range(1).select(terrain.size_class(F.lit(area))).first()[0] == label


def test_region_keys(spark):
    rows = spark.createDataFrame([("A B/C", " "), ("x" * 60, ""), ("A", " I.2 ")], "n STRING, c STRING")
    got = [r[0] for r in rows.select(terrain.region_key(F.col("n"), F.col("c"))).collect()]
    assert got == ["soiusa_A_B-C", "soiusa_" + "x" * 40, "soiusa_I.2"]
