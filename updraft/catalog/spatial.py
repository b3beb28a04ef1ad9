"""Spatial queries: region join, area overlap, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from updraft import fixtures as fx
from updraft.catalog.registry import query, rnd, rounded
from updraft.catalog.tracks import PHASE_OUT, TO_PHASE, detected
from updraft.operators import overlay, spatial
from updraft.operators.filters import BBox
from updraft.operators.phases import PHASE_COLUMNS
from updraft.session import scratch_path
from updraft.sources import regions as geo

IN_BOX = "lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1"
PHASE_IN_BOX = "lon_centroid >= x0 AND lon_centroid < x1 AND lat_centroid >= y0 AND lat_centroid < y1"
# 0.1 degree cells with their centre in each rectangle.
BOX_CELLS = """
, lattice AS (SELECT cx, cy FROM range(40, 180) a(cx), range(430, 495) b(cy))
, box_cells AS (SELECT region_id, cx, cy, COS(RADIANS((cy + 0.5e0) * 0.1e0)) AS weight FROM region_box, lattice
    WHERE (cx + 0.5e0) * 0.1e0 >= x0 AND (cx + 0.5e0) * 0.1e0 < x1 AND (cy + 0.5e0) * 0.1e0 >= y0 AND (cy + 0.5e0) * 0.1e0 < y1)"""

# A rectangle's interior point.
REP = """
, rep AS (SELECT region_id, (x0 + x1) / 2 AS lon, (y0 + y1) / 2 AS lat FROM region_box)"""


def phases_with_region(spark, d):
    return spatial.assign_region(detected(spark, d), fx.region(spark, d), "lon_centroid", "lat_centroid")


FLAGSHIP = fx.with_sql(
    "obs", "region_box", recursive=True,
    body=TO_PHASE + f"SELECT {PHASE_OUT}, region_id FROM phase LEFT JOIN region_box ON {PHASE_IN_BOX}",
)


@query("flagship_thermals", FLAGSHIP)
def _flagship(spark, d):
    found = phases_with_region(spark, d)
    return _rounded_with_region(found)


def _rounded_with_region(found):
    return rounded(
        found.select(*PHASE_COLUMNS, "region_id"), lat_centroid=4, lon_centroid=4, alt_mean_m=3, alt_base_m=3,
        alt_top_m=3, climb_rate_ms=4, n_turns=3,
    )


@query(
    "j1_assign_region",
    fx.with_sql("obs", "region_box", body=f"""SELECT source_id, rx, t_s, region_id, name FROM obs LEFT JOIN region_box ON {IN_BOX}"""),
)
def _j1(spark, d):
    found = spatial.assign_region(fx.obs(spark, d), fx.region(spark, d), attributes=("name",))
    return found.select("source_id", "rx", "t_s", "region_id", "name")


# Which slanted region holds a point: at most one, by the parity of its edges east of the point.
CROSSING = "(ya > lat) <> (yb > lat) AND lon < (xb - xa) * (lat - ya) / (yb - ya) + xa"


@query(
    "j1_assign_slanted_region",
    fx.with_sql("obs", "slanted_edge", body=f"""
    , banded AS (SELECT *, UNNEST(GENERATE_SERIES(CAST(FLOOR(LEAST(ya, yb) * 10) AS BIGINT), CAST(FLOOR(GREATEST(ya, yb) * 10) AS BIGINT))) AS band FROM slanted_edge)
    , hit AS (SELECT source_id, rx, t_s, region_id FROM obs JOIN banded ON band = CAST(FLOOR(lat * 10) AS BIGINT) AND {CROSSING} GROUP BY ALL HAVING COUNT(*) % 2 = 1)
    SELECT o.source_id, o.rx, o.t_s, CAST(h.region_id AS VARCHAR) AS region_id FROM obs o LEFT JOIN hit h ON h.source_id = o.source_id AND h.rx = o.rx AND h.t_s = o.t_s"""),
)
def _j1_slanted(spark, d):
    """Slanted edges, holes and two parts, written as GeoJSON and read back."""
    path = scratch_path(spark, "geojson")
    geo.to_geojson(fx.slanted_region(spark, d)).write.text(path)
    layer = geo.read_regions(spark, path, multi_line=False)
    return spatial.assign_region(fx.obs(spark, d), layer).select("source_id", "rx", "t_s", "region_id")


@query(
    "j2_reassign_regions",
    fx.with_sql("obs", "region_box", recursive=True, body=TO_PHASE + f"SELECT source_id, t_start_s, region_id FROM phase LEFT JOIN region_box ON {PHASE_IN_BOX}"),
)
def _j2(spark, d):
    stale = detected(spark, d).withColumn("region_id", F.lit(-1)).withColumn("terrain_type", F.lit("old"))
    return spatial.reassign_regions(stale, fx.region(spark, d)).select("source_id", "t_start_s", "region_id")


@query(
    "j3_classify_to_basin",
    fx.with_sql("obs", "region_box", body=f"""SELECT basin, COUNT(*) AS n FROM (SELECT COALESCE(CAST(region_id AS VARCHAR), '') AS basin
    FROM obs LEFT JOIN region_box ON {IN_BOX}) GROUP BY 1"""),
)
def _j3(spark, d):
    return spatial.classify_to_basin(fx.obs(spark, d), fx.region(spark, d)).groupBy("basin").agg(F.count("*").alias("n"))


# Groups for J4/J5: four overlapping rectangles per world region.
GROUPS_SQL = """
, grp AS (SELECT r_regionkey AS group_id, r_name AS group_name, 5.0e0 + 2.1e0 * r_regionkey AS gx0, 43.73e0 + 0.4e0 * r_regionkey AS gy0,
    5.0e0 + 2.1e0 * r_regionkey + 3.33e0 AS gx1, 43.73e0 + 0.4e0 * r_regionkey + 2.77e0 AS gy1 FROM region)"""


def groups(spark, d):
    key = F.col("r_regionkey")
    boxes = fx.table(spark, d, "region").select(
        key.alias("region_id"), F.col("r_name").alias("group_name"), key.alias("ord"),
        (5.0 + 2.1 * key).alias("x0"), (43.73 + 0.4 * key).alias("y0"),
        (5.0 + 2.1 * key + 3.33).alias("x1"), (43.73 + 0.4 * key + 2.77).alias("y1"),
    )
    return boxes.select("region_id", "group_name", "ord", F.array(fx.box_ring()).alias("rings"))


@query(
    "j4_assign_largest_overlap",
    fx.with_sql("region_box", body=GROUPS_SQL + """
    , shared AS (SELECT region_id, group_id, group_name, GREATEST(0, LEAST(x1, gx1) - GREATEST(x0, gx0)) * GREATEST(0, LEAST(y1, gy1) - GREATEST(y0, gy0)) AS w FROM region_box, grp)
    , best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY region_id ORDER BY ROUND(w, 9) DESC, group_id) AS rn FROM shared WHERE w > 1e-9)
    SELECT b.region_id, COALESCE(group_name, '') AS group_name FROM region_box b LEFT JOIN best s ON s.region_id = b.region_id AND rn = 1"""),
)
def _j4(spark, d):
    return spatial.assign_largest_overlap(fx.region(spark, d), groups(spark, d), ["group_name"]).select("region_id", "group_name")


@query(
    "j4_overlap_areas",
    fx.with_sql("slanted_edge", body=GROUPS_SQL + """
    , height AS (SELECT region_id, ya AS y FROM slanted_edge UNION SELECT e.region_id, gy FROM slanted_edge e, (SELECT gy0 AS gy FROM grp UNION SELECT gy1 FROM grp)
        UNION SELECT e.region_id, ya + (gx - xa) * (yb - ya) / (xb - xa) FROM slanted_edge e, (SELECT gx0 AS gx FROM grp UNION SELECT gx1 FROM grp) WHERE (xa > gx) <> (xb > gx))
    , slab AS (SELECT * FROM (SELECT region_id, y AS lo, LEAD(y) OVER (PARTITION BY region_id ORDER BY y) AS hi FROM height) WHERE hi > lo)
    , side AS (SELECT s.region_id, lo, hi, xa + (lo - ya) * (xb - xa) / (yb - ya) AS p, xa + (hi - ya) * (xb - xa) / (yb - ya) AS q FROM slab s JOIN slanted_edge e
        ON e.region_id = s.region_id AND LEAST(ya, yb) <= lo AND GREATEST(ya, yb) >= hi AND ya <> yb)
    , ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY region_id, lo ORDER BY p + q) AS k FROM side)
    , piece AS (SELECT w.region_id, w.lo, w.hi, w.p AS p1, w.q AS q1, e.p AS p2, e.q AS q2 FROM ranked w JOIN ranked e ON w.region_id = e.region_id AND w.lo = e.lo AND e.k = w.k + 1 AND w.k % 2 = 1)
    , cut AS (SELECT region_id, group_id, hi - lo AS h, GREATEST(0, LEAST(GREATEST(p2, gx0), gx1) - LEAST(GREATEST(p1, gx0), gx1)) AS below,
        GREATEST(0, LEAST(GREATEST(q2, gx0), gx1) - LEAST(GREATEST(q1, gx0), gx1)) AS above FROM piece, grp WHERE lo >= gy0 - 1e-12 AND hi <= gy1 + 1e-12)
    SELECT region_id, group_id, ROUND(SUM(h * (below + above) / 2), 6) AS area_deg2 FROM cut GROUP BY 1, 2 HAVING SUM(h * (below + above) / 2) > 1e-6"""),
)
def _j4_areas(spark, d):
    """Slanted regions with a hole and two parts against rectangles, cut into slabs by the SQL twin."""
    edges = [overlay.signed_edges(spatial.region_edges(layer)) for layer in (fx.slanted_region(spark, d), groups(spark, d))]
    return rounded(overlay.overlap_areas(*edges).where("area_deg2 > 1e-6"), area_deg2=6)


@query(
    "j5_assign_by_point",
    fx.with_sql("region_box", body=GROUPS_SQL + REP + """
    , hit AS (SELECT region_id, MIN(group_id) AS group_id FROM rep JOIN grp ON lon >= gx0 AND lon < gx1 AND lat >= gy0 AND lat < gy1 GROUP BY 1)
    SELECT b.region_id, COALESCE(group_name, '') AS group_name FROM region_box b LEFT JOIN hit h ON h.region_id = b.region_id LEFT JOIN grp g ON g.group_id = h.group_id"""),
)
def _j5(spark, d):
    return spatial.assign_by_point(fx.region(spark, d), groups(spark, d), ["group_name"]).select("region_id", "group_name")


@query(
    "j5_interior_points",
    fx.with_sql("slanted_edge", body="""
    , ring AS (SELECT region_id, MIN(ya) AS lo, MAX(ya) AS hi FROM (SELECT *, CASE WHEN vr <= 0.5e0 THEN 1 ELSE 2 END AS part FROM (
        SELECT *, (ya - MIN(ya) OVER (PARTITION BY region_id)) / (MAX(ya) OVER (PARTITION BY region_id) - MIN(ya) OVER (PARTITION BY region_id)) AS vr FROM slanted_edge)) GROUP BY region_id, part)
    , line AS (SELECT r.region_id, (MAX(CASE WHEN e.ya <= (lo + hi) / 2 THEN e.ya END) + MIN(CASE WHEN e.ya > (lo + hi) / 2 THEN e.ya END)) / 2 AS y
        FROM ring r JOIN slanted_edge e ON e.region_id = r.region_id GROUP BY r.region_id, lo, hi)
    , cut AS (SELECT l.region_id, y, xa + (y - ya) * (xb - xa) / (yb - ya) AS x FROM line l JOIN slanted_edge e ON e.region_id = l.region_id AND (ya > y) <> (yb > y))
    , along AS (SELECT *, LEAD(x) OVER w AS x_end, ROW_NUMBER() OVER w AS k FROM cut WINDOW w AS (PARTITION BY region_id, y ORDER BY x))
    , best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY region_id ORDER BY ROUND(x_end - x, 9) DESC, y, x) AS rn FROM along WHERE k % 2 = 1)
    SELECT region_id, ROUND((x + x_end) / 2, 6) AS lon, ROUND(y, 6) AS lat FROM best WHERE rn = 1"""),
)
def _j5_points(spark, d):
    return rounded(spatial.representative_points(fx.slanted_region(spark, d)), lon=6, lat=6)


@query(
    "j6_inside_bbox",
    fx.with_sql("region_box", body="""
    SELECT region_id, ROUND(f, 4) AS overlap_frac FROM (SELECT region_id, GREATEST(0, LEAST(x1, 13.33e0) - GREATEST(x0, 6.03e0)) * GREATEST(0, LEAST(y1, 47.53e0) - GREATEST(y0, 44.03e0)) / ((x1 - x0) * (y1 - y0)) AS f
        FROM region_box) WHERE f >= 0.3e0"""),
)
def _j6(spark, d):
    kept = spatial.inside_bbox(fx.region(spark, d), BBox(6.03, 44.03, 13.33, 47.53), 0.3)
    return kept.select("region_id", rnd("overlap_frac", 4).alias("overlap_frac"))


@query(
    "j7_neighbour_pairs",
    fx.with_sql("region_box", body="""SELECT a.region_id AS region_a, b.region_id AS region_b FROM region_box a JOIN region_box b ON a.ord < b.ord
    AND GREATEST(a.x0 - b.x1, b.x0 - a.x1, 0) < 0.001e0 AND GREATEST(a.y0 - b.y1, b.y0 - a.y1, 0) < 0.001e0"""),
)
def _j7(spark, d):
    return spatial.neighbour_pairs(fx.region(spark, d))


@query("r12_domain_cells", fx.with_sql("region_box", body=BOX_CELLS + "SELECT DISTINCT cx AS cell_x, cy AS cell_y FROM box_cells"))
def _r12(spark, d):
    return spatial.domain_cells(fx.region(spark, d), 0.1)
