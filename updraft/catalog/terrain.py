"""Terrain queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from updraft import fixtures as fx
from updraft.catalog.registry import query, rnd, rounded
from updraft.catalog.spatial import BOX_CELLS, GROUPS_SQL, REP, groups
from updraft.operators import components, spatial, terrain
from updraft.operators.filters import BBox

PIXEL_BOX = "lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1"
AHD = """
, ext AS (SELECT region_id, MIN(elev_m) AS lo, MAX(elev_m) AS hi, COUNT(*) AS n, MIN(pixel_area_m2) AS px FROM pixel GROUP BY 1)
, edge AS (SELECT region_id, n, px, CAST(FLOOR(lo / 100) AS BIGINT) AS b0, GREATEST(CAST(CEIL(hi / 100) AS BIGINT), CAST(FLOOR(lo / 100) AS BIGINT) + 1) AS b1 FROM ext)
, bins AS (SELECT region_id, n, px, UNNEST(GENERATE_SERIES(b0, b1 - 1)) AS b, b1 FROM edge)
, hist AS (SELECT s.region_id, s.b, s.n, s.px, COUNT(p.elev_m) AS k FROM bins s LEFT JOIN pixel p ON p.region_id = s.region_id AND p.elev_m >= s.b * 100 AND (p.elev_m < (s.b + 1) * 100 OR (s.b = s.b1 - 1 AND p.elev_m <= (s.b + 1) * 100)) GROUP BY 1, 2, 3, 4)
, ahd AS (SELECT region_id, b * 100.0e0 AS z_bottom_m, (b + 1) * 100.0e0 AS z_top_m, k * px AS s_g_m2,
    n * px * 100 - px * 100 * (n - SUM(k) OVER (PARTITION BY region_id ORDER BY b) + 0.5e0 * k) AS v_a_m3 FROM hist)"""
RELIEF = """
, relief AS (SELECT region_id, MIN(CASE WHEN s_g_m2 > 0 THEN z_bottom_m END) AS elev_min_m, MAX(CASE WHEN s_g_m2 > 0 THEN z_top_m END) - MIN(CASE WHEN s_g_m2 > 0 THEN z_bottom_m END) AS elev_range_m,
    MAX(z_top_m) - MIN(z_bottom_m) AS full_range_m FROM ahd GROUP BY 1)"""


def ahd(spark, d):
    return terrain.area_height_distribution(fx.pixel(spark, d))


def relief(spark, d):
    return terrain.relief_columns(ahd(spark, d))


@query("r1_pixels_in_region", fx.with_sql("located_pixel", "region_box", body=f"SELECT region_id, COUNT(*) AS n, ROUND(SUM(elev_m), 2) AS elev_sum FROM located_pixel JOIN region_box ON {PIXEL_BOX} GROUP BY 1"))
def _r1(spark, d):
    placed = terrain.pixels_in_region(fx.located_pixel(spark, d), fx.region(spark, d), require_all=True)
    return placed.groupBy("region_id").agg(F.count("*").alias("n"), rnd(F.sum("elev_m"), 2).alias("elev_sum"))


@query("r2_area_height_distribution", fx.with_sql("pixel", body=AHD + "SELECT region_id, z_bottom_m, z_top_m, s_g_m2, v_a_m3 FROM ahd"))
def _r2(spark, d):
    return ahd(spark, d)


@query("r3_zonal_stats", fx.with_sql("pixel", body="SELECT region_id, ROUND(AVG(elev_m), 3) AS mean_elev_m, COUNT(*) AS n_pixels, SUM(pixel_area_m2) AS area_m2 FROM pixel GROUP BY 1"))
def _r3(spark, d):
    return rounded(terrain.zonal_stats(fx.pixel(spark, d)), mean_elev_m=3)


@query("r4_relief_columns", fx.with_sql("pixel", body=AHD + RELIEF + "SELECT * FROM relief"))
def _r4(spark, d):
    return relief(spark, d)


@query(
    "r5_terrain_classes",
    fx.with_sql("pixel", "region_box", body=GROUPS_SQL + REP + AHD + RELIEF + """
    SELECT b.region_id, CASE WHEN EXISTS (SELECT 1 FROM grp WHERE r.lon >= gx0 AND r.lon < gx1 AND r.lat >= gy0 AND r.lat < gy1) THEN 'alpine'
      WHEN f.elev_range_m >= 400 THEN 'mittelgebirge' WHEN f.elev_range_m IS NOT NULL THEN 'flachland' ELSE 'non_alpine' END AS terrain_type
    FROM region_box b JOIN rep r ON r.region_id = b.region_id LEFT JOIN relief f ON f.region_id = b.region_id AND b.region_id % 7 <> 3"""),
)
def _r5(spark, d):
    known = F.when(F.col("region_id") % 7 != 3, F.col("elev_range_m"))
    partial = relief(spark, d).withColumn("elev_range_m", known)
    out = terrain.terrain_classes(fx.region(spark, d), groups(spark, d), partial)
    return out.select("region_id", "terrain_type")


@query(
    "j13_annotate_regions",
    fx.with_sql("pixel", "region_box", body=AHD + RELIEF + """, z AS (SELECT region_id, AVG(elev_m) AS m FROM pixel GROUP BY 1)
    , j AS (SELECT b.region_id, m, f.full_range_m, CASE WHEN b.region_id % 2 = 0 THEN 'alpine' ELSE 'non_alpine' END AS t
      FROM region_box b LEFT JOIN z ON z.region_id = b.region_id LEFT JOIN relief f ON f.region_id = b.region_id)
    SELECT region_id, ROUND(m, 3) AS mean_elev_m, full_range_m AS elev_range_m, CASE WHEN COALESCE(m, 0) > 600 THEN 'alpine' ELSE 'vorland' END AS habitat_class,
      CASE WHEN t <> 'non_alpine' THEN t WHEN full_range_m >= 400 THEN 'mittelgebirge' WHEN full_range_m IS NOT NULL THEN 'flachland' ELSE 'non_alpine' END AS terrain_type FROM j"""),
)
def _j13(spark, d):
    kind = F.when(F.col("region_id") % 2 == 0, "alpine").otherwise("non_alpine")
    regions = fx.region(spark, d).select("region_id", kind.alias("terrain_type"))
    out = terrain.annotate_regions(regions, terrain.zonal_stats(fx.pixel(spark, d)), relief(spark, d))
    return rounded(out.select("region_id", "mean_elev_m", "elev_range_m", "habitat_class", "terrain_type"), mean_elev_m=3)


# Region sizes and shapes for the split rule.
SHAPES = """
, shapes AS (SELECT region_id, 300.0e0 * (region_id % 8) AS area_km2, CASE WHEN region_id % 5 = 4 THEN NULL ELSE 0.7e0 * (region_id % 6) END AS aspect_ratio FROM region_box)"""


def shaped(spark, d):
    key = F.col("region_id")
    shapes = fx.region(spark, d).select(
        "region_id", (300.0 * (key % 8)).alias("area_km2"), F.when(key % 5 != 4, 0.7 * (key % 6)).alias("aspect_ratio")
    )
    return shapes.join(relief(spark, d), "region_id", "left")


@query(
    "r6_split_candidates",
    fx.with_sql("pixel", "region_box", body=AHD + RELIEF + SHAPES + """SELECT region_id FROM shapes JOIN relief USING (region_id)
    WHERE COALESCE(elev_range_m > 2000 AND elev_min_m < 800 AND (aspect_ratio > 2 OR area_km2 > 1500), FALSE)"""),
)
def _r6(spark, d):
    return terrain.split_candidates(shaped(spark, d)).select("region_id")


BANDED = """
, cand AS (SELECT region_id, area_km2, region_id % 3 <> 0 AS candidate FROM shapes)
, band_area AS (SELECT p.region_id, CASE WHEN elev_m < 800 THEN 'flachland' WHEN elev_m < 1500 THEN 'voralpen' ELSE 'hochgebirge' END AS band,
    CASE WHEN elev_m < 800 THEN 1 WHEN elev_m < 1500 THEN 2 ELSE 3 END AS rk, SUM(pixel_area_m2) / 1e6 AS a FROM pixel p JOIN cand c ON c.region_id = p.region_id AND candidate GROUP BY 1, 2, 3)
, top AS (SELECT region_id, FIRST_VALUE(band) OVER (PARTITION BY region_id ORDER BY a DESC, rk) AS top_band, band, a FROM band_area)
, target AS (SELECT *, CASE WHEN a < 0.6e0 AND band <> top_band THEN top_band ELSE band END AS target FROM top)
, kinds AS (SELECT region_id FROM target GROUP BY 1 HAVING COUNT(DISTINCT target) > 1)
, split AS (SELECT t.* FROM target t JOIN kinds USING (region_id))"""


def banded(spark, d):
    regions = shaped(spark, d).withColumn("candidate", F.col("region_id") % 3 != 0)
    # 0.9 km2 per 1000 pixels: the threshold follows the fixture's pixel size.
    return terrain.elevation_bands(fx.pixel(spark, d), regions, 0.6)


@query(
    "r7_elevation_bands",
    fx.with_sql("pixel", "region_box", body=SHAPES + BANDED + """
    SELECT region_id, CAST(region_id AS VARCHAR) || '_' || target AS segment_id, target AS band, ROUND(SUM(CASE WHEN band = target THEN a END), 4) AS area_km2, ROUND(SUM(a), 4) AS area_total_km2 FROM split GROUP BY 1, 2, 3
    UNION ALL SELECT region_id, CAST(region_id AS VARCHAR), 'whole', ROUND(area_km2, 4), ROUND(area_km2, 4) FROM cand WHERE region_id NOT IN (SELECT region_id FROM split)"""),
)
def _r7(spark, d):
    return rounded(banded(spark, d)[0], area_km2=4, area_total_km2=4)


@query(
    "r7_label_pixels",
    fx.with_sql("pixel", "region_box", body=SHAPES + BANDED + """
    , lab AS (SELECT p.region_id, elev_m, CASE WHEN elev_m < 800 THEN 'flachland' WHEN elev_m < 1500 THEN 'voralpen' ELSE 'hochgebirge' END AS band FROM pixel p)
    SELECT COALESCE(CAST(s.region_id AS VARCHAR) || '_' || s.target, CAST(l.region_id AS VARCHAR)) AS segment_id, COUNT(*) AS n FROM lab l LEFT JOIN split s ON s.region_id = l.region_id AND s.band = l.band GROUP BY 1"""),
)
def _r7_pixels(spark, d):
    labelled = terrain.label_pixels(fx.pixel(spark, d), banded(spark, d)[1])
    return labelled.groupBy("segment_id").agg(F.count("*").alias("n"))


PASSES = """
    , near AS (SELECT lon, lat, elev_m, region_id FROM located_pixel, region_box WHERE
        (lat BETWEEN y0 - 0.0061e0 AND y1 + 0.0061e0 AND (ABS(lon - x0) <= 0.0061e0 OR ABS(lon - x1) <= 0.0061e0)) OR (lon BETWEEN x0 - 0.0061e0 AND x1 + 0.0061e0 AND (ABS(lat - y0) <= 0.0061e0 OR ABS(lat - y1) <= 0.0061e0)))
    , low AS (SELECT a.region_id AS region_a, b.region_id AS region_b, MIN(a.elev_m) AS z FROM near a JOIN near b ON a.lon = b.lon AND a.lat = b.lat AND a.region_id < b.region_id GROUP BY 1, 2)
    , filled AS (SELECT region_a, region_b, z, COALESCE(fa.elev_min_m, z) AS a, COALESCE(fb.elev_min_m, z) AS b FROM low LEFT JOIN relief fa ON fa.region_id = region_a LEFT JOIN relief fb ON fb.region_id = region_b)
    , passes AS (SELECT region_a, region_b, z, a, b, GREATEST(0, z - GREATEST(a, b)) AS rel FROM filled WHERE ABS(region_a % 5 - region_b % 5) + ABS(region_a // 5 - region_b // 5) = 1)"""


def passes(spark, d):
    # Pairs with a common side; the fixture's pixels lie 0.005 degrees off the borders.
    a, b = F.col("region_a"), F.col("region_b")
    side = F.abs(a % 5 - b % 5) + F.abs(F.floor(a / 5) - F.floor(b / 5)) == 1
    pairs = spatial.neighbour_pairs(fx.region(spark, d)).where(side)
    return terrain.pass_height(pairs, fx.located_pixel(spark, d), fx.region(spark, d), relief(spark, d), 0.0061)


@query(
    "r8_pass_height",
    fx.with_sql("pixel", "located_pixel", "region_box", body=AHD + RELIEF + PASSES + """
    SELECT region_a, region_b, ROUND(z, 3) AS threshold_z_m, a AS valley_floor_a_m, b AS valley_floor_b_m, ROUND(rel, 3) AS relative_threshold_m FROM passes"""),
)
def _r8(spark, d):
    return rounded(passes(spark, d), threshold_z_m=3, relative_threshold_m=3)


NAMED = """
, basin AS (SELECT c_custkey AS region_id, c_acctbal AS area_km2, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'Group ' || CAST(c_nationkey AS VARCHAR) || '/' || c_mktsegment END AS soiusa_name,
    CASE WHEN c_nationkey % 3 = 0 THEN 'I.' || CAST(c_nationkey AS VARCHAR) ELSE '' END AS soiusa_code, CAST(c_nationkey * 1000 AS VARCHAR) AS osm_id FROM customer)
, grp AS (SELECT 'Group ' || CAST(n_nationkey AS VARCHAR) || '/BUILDING' AS soiusa_name, '' AS soiusa_code, CAST(n_nationkey AS VARCHAR) AS osm_id FROM nation
    UNION ALL SELECT n_name, '', CAST(n_nationkey AS VARCHAR) FROM nation)
, realised AS (SELECT soiusa_name, ARG_MIN(soiusa_code, region_id) AS soiusa_code, ARG_MIN(osm_id, region_id) AS osm_id, COUNT(*) AS n_basins, SUM(area_km2) AS area_km2 FROM basin WHERE soiusa_name <> '' GROUP BY 1
    UNION ALL SELECT soiusa_name, soiusa_code, osm_id, 0, NULL FROM grp WHERE soiusa_name NOT IN (SELECT soiusa_name FROM basin))
, keyed AS (SELECT 'soiusa_' || CASE WHEN TRIM(soiusa_code) <> '' THEN TRIM(soiusa_code) ELSE SUBSTRING(REPLACE(REPLACE(soiusa_name, ' ', '_'), '/', '-'), 1, 40) END AS region_id, * , 'alpine' AS terrain_type FROM realised)"""


def named_basins(spark, d):
    key = F.col("c_nationkey")
    name = F.concat(F.lit("Group "), key.cast("string"), F.lit("/"), F.col("c_mktsegment"))
    return fx.table(spark, d, "customer").select(
        F.col("c_custkey").alias("region_id"), F.col("c_acctbal").alias("area_km2"),
        F.when(F.col("c_custkey") % 6 == 0, "").otherwise(name).alias("soiusa_name"),
        F.when(key % 3 == 0, F.concat(F.lit("I."), key.cast("string"))).otherwise("").alias("soiusa_code"),
        (key * 1000).cast("string").alias("osm_id"),
    )


def named_groups(spark, d):
    nation = fx.table(spark, d, "nation")
    building = F.concat(F.lit("Group "), F.col("n_nationkey").cast("string"), F.lit("/BUILDING"))
    ids = F.col("n_nationkey").cast("string").alias("osm_id")
    return nation.select(building.alias("name_de"), ids).unionByName(nation.select(F.col("n_name").alias("name_de"), ids))


GROUP_OUT = "region_id, soiusa_name, soiusa_code, osm_id, n_basins, ROUND(area_km2, 2) AS area_km2, terrain_type"


@query("r9_realise_groups", "WITH" + NAMED[2:] + f"SELECT {GROUP_OUT} FROM keyed")
def _r9(spark, d):
    return rounded(terrain.realise_groups(named_basins(spark, d), named_groups(spark, d)), area_km2=2)


@query(
    "u1_regions_with_rest",
    "WITH" + NAMED[2:] + f"SELECT {GROUP_OUT} FROM keyed UNION ALL SELECT 'hb8_' || CAST(region_id AS VARCHAR), '', soiusa_code, osm_id, 1, ROUND(area_km2, 2), 'non_alpine' FROM basin WHERE soiusa_name = ''",
)
def _u1(spark, d):
    return rounded(terrain.regions_with_rest(named_basins(spark, d), named_groups(spark, d)), area_km2=2)


BOUNDS = """, bounds AS (SELECT s_suppkey AS id, s_nationkey * 1.7e0 - 14.0e0 AS min_lon, s_nationkey * 0.9e0 - 6.0e0 AS min_lat, s_nationkey * 1.7e0 - 14.0e0 + (s_suppkey % 5) * 0.6e0 AS max_lon, s_nationkey * 0.9e0 - 6.0e0 + (s_suppkey % 4) * 0.7e0 AS max_lat FROM supplier)
, tiles AS (SELECT id, tile_lat, tile_lon, 'Copernicus_DSM_COG_10_' || CASE WHEN tile_lat >= 0 THEN 'N' ELSE 'S' END || LPAD(CAST(ABS(tile_lat) AS VARCHAR), 2, '0') || '_00_' || CASE WHEN tile_lon >= 0 THEN 'E' ELSE 'W' END || LPAD(CAST(ABS(tile_lon) AS VARCHAR), 3, '0') || '_00_DEM' AS tile
    FROM bounds, range(-90, 90) a(tile_lat), range(-180, 180) o(tile_lon) WHERE tile_lat >= FLOOR(min_lat) AND tile_lat < CEIL(max_lat) AND tile_lon >= FLOOR(min_lon) AND tile_lon < CEIL(max_lon))"""


def tiles(spark, d):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    west, south = nation * 1.7 - 14.0, nation * 0.9 - 6.0
    return terrain.tile_cover(
        fx.table(spark, d, "supplier").select(
            key.alias("id"), west.alias("min_lon"), south.alias("min_lat"),
            (west + (key % 5) * 0.6).alias("max_lon"), (south + (key % 4) * 0.7).alias("max_lat"),
        )
    )


@query("r10_tile_cover", "WITH" + BOUNDS[1:] + "SELECT id, tile FROM tiles")
def _r10(spark, d):
    return tiles(spark, d).select("id", "tile")


@query("r10_missing_tiles", "WITH" + BOUNDS[1:] + "SELECT DISTINCT tile FROM tiles WHERE tile NOT IN (SELECT tile FROM tiles WHERE id % 10 = 3)")
def _r10_missing(spark, d):
    return terrain.missing_tiles(tiles(spark, d), tiles(spark, d).where("id % 10 = 3"))


@query(
    "r13_refine_region",
    fx.with_sql("region_box", body=BOX_CELLS + """
    , ov AS (SELECT region_id, GREATEST(0, LEAST(x1, 13.03e0) - GREATEST(x0, 8.03e0)) * GREATEST(0, LEAST(y1, 46.93e0) - GREATEST(y0, 44.43e0)) / ((x1 - x0) * (y1 - y0)) AS f FROM region_box)
    , pick AS (SELECT region_id FROM ov WHERE f >= 0.5e0)
    , cells AS (SELECT DISTINCT cx, cy FROM box_cells JOIN pick USING (region_id) WHERE (cx + 0.5e0) * 0.1e0 BETWEEN 8.0e0 AND 12.0e0 AND (cy + 0.5e0) * 0.1e0 BETWEEN 44.0e0 AND 47.0e0)
    SELECT region_id AS basin_id, (SELECT COUNT(*) FROM pick) AS n_basins, (SELECT COUNT(*) FROM cells) AS n_cells FROM pick"""),
)
def _r13(spark, d):
    cells, provenance = terrain.refine_region(
        fx.region(spark, d), BBox(8.03, 44.43, 13.03, 46.93), 0.5, BBox(8.0, 44.0, 12.0, 47.0), 0.1
    )
    n_cells = cells.agg(F.count("*")).scalar()
    return provenance.withColumn("n_cells", n_cells)


# -- high terrain ------------------------------------------------------------

FRAME = (0, 0, 149, 68)
THRESHOLD = 1600.0


def blocks(spark, d):
    px = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 1200
    py = (F.col("l_partkey") * 3 + F.col("l_suppkey")) % 550
    pixels = fx.table(spark, d, "lineitem").select(
        px.alias("x"), py.alias("y"), (400.0 + F.col("l_quantity") * 40 + (F.col("l_suppkey") % 7) * 60).alias("elev_m")
    )
    return components.block_means(pixels, 8)


def _shift(src: str, dst: str, op: str) -> str:
    if op == "dilate":
        return f", {dst} AS (SELECT DISTINCT x + dx AS x, y + dy AS y FROM {src}, steps WHERE x + dx BETWEEN 0 AND 149 AND y + dy BETWEEN 0 AND 68)"
    return f", {dst} AS (SELECT x + dx AS x, y + dy AS y FROM {src}, steps GROUP BY 1, 2 HAVING COUNT(*) = 5)"


@query(
    "r11_high_terrain_mask",
    """WITH px AS (SELECT (l_orderkey * 7 + l_linenumber * 131) % 1200 AS x, (l_partkey * 3 + l_suppkey) % 550 AS y, 400.0e0 + l_quantity * 40 + (l_suppkey % 7) * 60 AS e FROM lineitem)
    , steps AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy))
    , m0 AS (SELECT x, y FROM (SELECT CAST(FLOOR(x / 8.0e0) AS BIGINT) AS x, CAST(FLOOR(y / 8.0e0) AS BIGINT) AS y, AVG(e) AS e FROM px GROUP BY 1, 2) WHERE e >= 1600)"""
    + _shift("m0", "d1", "dilate") + _shift("d1", "e1", "erode") + "SELECT x, y FROM e1",
)
def _r11_mask(spark, d):
    return components.high_terrain_mask(blocks(spark, d), FRAME, THRESHOLD, 1)


def _filled(src: str, dst: str) -> str:
    """Adds the parts of the complement that a walk from the rim does not reach."""
    return f"""
    , {dst}_out AS (SELECT a.x, b.y FROM range(0, 150) a(x), range(0, 69) b(y) WHERE (a.x, b.y) NOT IN (SELECT (x, y) FROM {src}))
    , {dst}_open AS (SELECT x, y FROM {dst}_out WHERE x IN (0, 149) OR y IN (0, 68)
        UNION SELECT o.x, o.y FROM {dst}_open w, steps s, {dst}_out o WHERE o.x = w.x + s.dx AND o.y = w.y + s.dy)
    , {dst} AS (SELECT x, y FROM {src} UNION SELECT x, y FROM {dst}_out WHERE (x, y) NOT IN (SELECT (x, y) FROM {dst}_open))"""


HIGH = """WITH RECURSIVE px AS (SELECT (l_orderkey * 7 + l_linenumber * 131) % 1200 AS x, (l_partkey * 3 + l_suppkey) % 550 AS y, 400.0e0 + l_quantity * 40 + (l_suppkey % 7) * 60 AS e FROM lineitem)
    , steps AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy))
    , m0 AS (SELECT x, y FROM (SELECT CAST(FLOOR(x / 8.0e0) AS BIGINT) AS x, CAST(FLOOR(y / 8.0e0) AS BIGINT) AS y, AVG(e) AS e FROM px GROUP BY 1, 2) WHERE e >= 1600)"""
# Every cell takes the least label of its neighbours until none changes.
LARGEST = """
    , lab(x, y, label) USING KEY (x, y) AS (SELECT x, y, y * 1000 + x FROM solid
        UNION SELECT t.x, t.y, MIN(w.label) FROM lab w, steps s, recurring.lab t WHERE t.x = w.x + s.dx AND t.y = w.y + s.dy AND w.label < t.label GROUP BY 1, 2)
    , top AS (SELECT label FROM lab GROUP BY 1 ORDER BY COUNT(*) DESC, label LIMIT 1)
    , main AS (SELECT x, y FROM lab WHERE label = (SELECT label FROM top))"""


def _closed(rounds: int) -> str:
    ops = ["dilate"] * rounds + ["erode"] * rounds
    names = ["m0", *[f"k{i}" for i in range(1, 2 * rounds + 1)]]
    return "".join(_shift(a, b, op) for a, b, op in zip(names, names[1:], ops, strict=False))


def component_sql(rounds: int) -> str:
    last = f"k{2 * rounds}" if rounds else "m0"
    return HIGH + _closed(rounds) + _filled(last, "solid") + LARGEST + _filled("main", "whole") + " SELECT x, y FROM whole"


@query("r11_high_terrain_component", component_sql(0))
def _r11(spark, d):
    return components.high_terrain_component(blocks(spark, d), FRAME, THRESHOLD, 0)


@query("r11_high_terrain_closed", component_sql(3))
def _r11_closed(spark, d):
    """With the default closing; the higher threshold leaves several parts to choose from."""
    return components.high_terrain_component(blocks(spark, d), FRAME, THRESHOLD, 3)


# -- scalar columns ----------------------------------------------------------


@query(
    "p12_size_and_side",
    """SELECT c_custkey, CASE WHEN a < 100 THEN 'small' WHEN a < 500 THEN 'small_alpine' WHEN a < 1500 THEN 'liechti' WHEN a < 3000 THEN 'large' ELSE 'huge' END AS size_class,
    CASE WHEN COALESCE(b, 0) < 100 THEN '<100' WHEN b < 500 THEN '100–500' WHEN b < 1500 THEN '500–1500' ELSE '>1500' END AS size_band,
    CASE WHEN lat > 47.2e0 THEN 'N' WHEN lat < 46.2e0 THEN 'S' ELSE 'C' END AS n_side
    FROM (SELECT c_custkey, ABS(c_acctbal) AS a, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE ABS(c_acctbal) END AS b, 45.5e0 + c_nationkey * 0.1e0 AS lat FROM customer)""",
)
def _p12(spark, d):
    area = F.abs("c_acctbal")
    return fx.table(spark, d, "customer").select(
        "c_custkey",
        terrain.size_class(area).alias("size_class"),
        terrain.size_band(F.when(F.col("c_custkey") % 13 != 0, area)).alias("size_band"),
        terrain.n_side(45.5 + F.col("c_nationkey") * 0.1).alias("n_side"),
    )


@query(
    "p17_aspect_ratio",
    fx.with_sql("region_box", body="""SELECT region_id, ROUND(GREATEST(w, h) / LEAST(w, h), 4) AS aspect_ratio
    FROM (SELECT region_id, (x1 - x0) * 111 * COS(RADIANS((y0 + y1) / 2)) AS w, (y1 - y0) * 111.0e0 AS h FROM region_box)"""),
)
def _p17(spark, d):
    return rounded(terrain.aspect_ratio(fx.region(spark, d)).select("region_id", "aspect_ratio"), aspect_ratio=4)


@query(
    "p18_region_key",
    "WITH" + NAMED[2:] + "SELECT region_id AS basin_id, 'soiusa_' || CASE WHEN TRIM(soiusa_code) <> '' THEN TRIM(soiusa_code) ELSE SUBSTRING(REPLACE(REPLACE(soiusa_name, ' ', '_'), '/', '-'), 1, 40) END AS region_key FROM basin",
)
def _p18(spark, d):
    key = terrain.region_key(F.col("soiusa_name"), F.col("soiusa_code"))
    return named_basins(spark, d).select(F.col("region_id").alias("basin_id"), key.alias("region_key"))


@query(
    "p19_normalise_group_names",
    "SELECT p_partkey AS osm_id, COALESCE(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END, '') AS soiusa_name, '' AS soiusa_code FROM part",
)
def _p19(spark, d):
    name = F.when(F.col("p_partkey") % 5 != 0, F.col("p_name"))
    raw = fx.table(spark, d, "part").select(F.col("p_partkey").alias("osm_id"), name.alias("name"))
    return terrain.normalise_group_names(raw).select("osm_id", "soiusa_name", "soiusa_code")


@query(
    "p20_log_scale_position",
    """WITH a AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN LOG10(c_acctbal) END AS l FROM customer)
    SELECT c_custkey, ROUND((l - (SELECT MIN(l) FROM a)) / ((SELECT MAX(l) FROM a) - (SELECT MIN(l) FROM a)), 4) AS position FROM a""",
)
def _p20(spark, d):
    areas = fx.table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("area_km2"))
    return rounded(terrain.log_scale_position(areas).select("c_custkey", "position"), position=4)
