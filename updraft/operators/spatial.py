"""Polygons without a geometry library.

A region layer is ``(region_id, ord, ..., rings)`` where ``rings`` is an array
of closed rings of ``(lon, lat)`` points. Holes and multipolygons need no
special care: a point is inside when a ray to the east crosses an odd number of
edges over all rings. Borders are half open, so a point on a shared border lies
in at most one of two neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from updraft.operators import overlay
from updraft.session import broadcast_if_small

#: Cell width in degrees of the point-to-region join key.
JOIN_CELL_DEG = 0.25
#: Edges one cell may carry before cells are halved, and a cover to broadcast.
MAX_CELL_EDGES = 2_000
BROADCAST_EDGES = 2_000_000


def cell_index(value: Column, cell_deg: float) -> Column:
    return F.floor(value / F.lit(cell_deg))


def region_edges(regions: DataFrame) -> DataFrame:
    """One row per polygon edge: ``region_id, ord, ring_id, x1, y1, x2, y2``.

    ``west`` is the region's smallest longitude.
    """
    west = F.array_min(F.transform(F.flatten("rings"), lambda p: p["lon"]))
    placed = regions.select("region_id", "ord", west.alias("west"), "rings")
    rings = placed.select("region_id", "ord", "west", F.posexplode("rings").alias("ring_id", "ring"))
    pairs = F.arrays_zip(
        F.slice("ring", F.lit(1), F.size("ring") - 1).alias("a"), F.slice("ring", F.lit(2), F.size("ring") - 1).alias("b")
    )
    return rings.select("region_id", "ord", "west", "ring_id", F.explode(pairs).alias("e")).select(
        "region_id",
        "ord",
        "west",
        "ring_id",
        F.col("e.a.lon").alias("x1"),
        F.col("e.a.lat").alias("y1"),
        F.col("e.b.lon").alias("x2"),
        F.col("e.b.lat").alias("y2"),
    )


def crosses_east(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether the eastward ray from a point crosses an edge."""
    straddles = (y1 > py) != (y2 > py)
    return straddles & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)


def region_cover(regions: DataFrame, cell_deg: float = JOIN_CELL_DEG) -> DataFrame:
    """Per grid cell the regions that may hold points of it, in layer order.

    Each candidate carries only the edges an eastward ray from that cell can
    meet, so long borders are not repeated in full per cell.
    """
    edges = region_edges(regions).where("y1 <> y2")
    reach = edges.select(
        "*",
        F.explode(
            F.sequence(cell_index(F.least("y1", "y2"), cell_deg), cell_index(F.greatest("y1", "y2"), cell_deg))
        ).alias("cell_y"),
    )
    placed = reach.select(
        "*",
        F.explode(
            F.sequence(cell_index(F.col("west"), cell_deg), cell_index(F.greatest("x1", "x2"), cell_deg))
        ).alias("cell_x"),
    )
    candidates = placed.groupBy("cell_x", "cell_y", "ord", "region_id").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges")
    )
    return candidates.groupBy("cell_x", "cell_y").agg(
        F.array_sort(F.collect_list(F.struct("ord", "region_id", "edges"))).alias("candidates")
    )


def _containing(lon: Column, lat: Column) -> Column:
    """Candidates of the point's cell that contain it, in layer order."""

    def inside(candidate: Column) -> Column:
        crossings = F.filter(
            candidate["edges"],
            lambda e: crosses_east(lon, lat, e["x1"], e["y1"], e["x2"], e["y2"]),
        )
        return F.size(crossings) % 2 == 1

    return F.filter("candidates", inside)


def fitted_cover(regions: DataFrame, cell_deg: float) -> tuple[DataFrame, float]:
    """Cover with cells small enough that none carries a long list of edges.

    Dense borders halve the cell until the longest list is short, or until
    halving stops helping; any cell width gives the same result. The cover is
    offered for broadcast only when its edges, counted here, are few.
    """
    longest = None
    while True:
        cover = region_cover(regions, cell_deg)
        edges = F.aggregate("candidates", F.lit(0), lambda n, c: n + F.size(c["edges"]))
        found = cover.agg(F.max(edges).alias("longest"), F.sum(edges).alias("total")).first()
        fits = found.longest is None or found.longest <= MAX_CELL_EDGES
        if fits or (longest is not None and found.longest > 0.8 * longest):
            small = (found.total or 0) <= BROADCAST_EDGES
            return (F.broadcast(cover) if small else cover), cell_deg
        longest, cell_deg = found.longest, cell_deg / 2


def _with_hits(points: DataFrame, regions: DataFrame, lon: str, lat: str, cell_deg: float, how: str) -> DataFrame:
    # One cover row per cell: the join never multiplies points, and while the
    # cover is small enough to broadcast the points are not shuffled at all.
    cover, cell_deg = fitted_cover(regions, cell_deg)
    keyed = points.withColumn("cell_x", cell_index(F.col(lon), cell_deg)).withColumn(
        "cell_y", cell_index(F.col(lat), cell_deg)
    )
    joined = keyed.join(cover, ["cell_x", "cell_y"], how)
    return joined.withColumn("_hits", _containing(F.col(lon), F.col(lat))).drop("cell_x", "cell_y", "candidates")


def assign_region(
    points: DataFrame,
    regions: DataFrame,
    lon: str = "lon",
    lat: str = "lat",
    attributes: tuple[str, ...] = (),
    cell_deg: float = JOIN_CELL_DEG,
) -> DataFrame:
    """Adds the first region, in layer order, that contains each point.

    Points outside every region keep a null ``region_id``. ``attributes`` of the
    region layer are copied along where the layer has them.
    """
    hits = _with_hits(points, regions, lon, lat, cell_deg, "left")
    first = F.when(F.size("_hits") > 0, F.try_element_at("_hits", F.lit(1)))
    found = hits.withColumn("region_id", first["region_id"]).drop("_hits")
    present = [a for a in attributes if a in regions.columns]
    if not present:
        return found
    return found.join(broadcast_if_small(regions.select("region_id", *present)), "region_id", "left")


def reassign_regions(phases: DataFrame, regions: DataFrame, attributes=("terrain_type", "habitat_class")) -> DataFrame:
    """Replays the region join on phases that already carry region columns."""
    bare = phases.drop("region_id", *attributes)
    return assign_region(bare, regions, "lon_centroid", "lat_centroid", tuple(attributes))


def classify_to_basin(points: DataFrame, basins: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Containing basin as text, the empty string outside all basins."""
    found = assign_region(points, basins, lon, lat)
    return found.withColumn("basin", F.coalesce(F.col("region_id").cast("string"), F.lit(""))).drop("region_id")


def points_in_regions(
    points: DataFrame, regions: DataFrame, lon: str = "lon", lat: str = "lat", cell_deg: float = JOIN_CELL_DEG,
    outside: bool = False,
) -> DataFrame:
    """One row per point and containing region; overlapping layers repeat points.

    With ``outside`` points in no region stay, once, with a null ``region_id``.
    """
    hits = _with_hits(points, regions, lon, lat, cell_deg, "left" if outside else "inner")
    each = F.explode_outer if outside else F.explode
    return hits.withColumn("_hit", each("_hits")).withColumn("region_id", F.col("_hit.region_id")).drop("_hits", "_hit")


# -- area by fine cells ------------------------------------------------------


def covered_cells(regions: DataFrame, cell_deg: float) -> DataFrame:
    """Grid cells whose centre lies in a region: ``region_id, cell_x, cell_y, weight``.

    A scanline per cell row: sorted edge crossings pair up into spans of covered
    columns. ``weight`` is the cosine of the row's latitude. Areas built from
    these cells are approximate, to about perimeter times cell width.
    """
    edges = region_edges(regions).where("y1 <> y2")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first_row = F.ceil(low / cell_deg - 0.5)
    last_row = F.ceil(high / cell_deg - 0.5) - 1
    rows = edges.withColumn("_from", first_row).withColumn("_to", last_row).where("_from <= _to")
    scan = rows.select("*", F.explode(F.sequence("_from", "_to")).alias("cell_y"))
    centre = (F.col("cell_y") + 0.5) * cell_deg
    crossing = (F.col("x2") - F.col("x1")) * (centre - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    crossings = scan.select("region_id", "cell_y", crossing.alias("x"))
    along = W.partitionBy("region_id", "cell_y").orderBy("x")
    spans = (
        crossings.withColumn("_i", F.row_number().over(along))
        .withColumn("_x_end", F.lead("x").over(along))
        .where("_i % 2 = 1")
        .withColumn("_from", F.ceil(F.col("x") / cell_deg - 0.5))
        .withColumn("_to", F.ceil(F.col("_x_end") / cell_deg - 0.5) - 1)
        .where("_from <= _to")
    )
    weight = F.cos(F.radians((F.col("cell_y") + 0.5) * cell_deg))
    return spans.select(
        "region_id", F.explode(F.sequence("_from", "_to")).alias("cell_x"), "cell_y", weight.alias("weight")
    )


def assign_largest_overlap(basins: DataFrame, groups: DataFrame, attributes: list[str]) -> DataFrame:
    """Each basin with the group that shares most area, empty text if none; the first in layer order on ties."""
    mine, theirs = [overlay.signed_edges(region_edges(layer)) for layer in (basins, groups)]
    shared = overlay.overlap_areas(mine, theirs).join(overlay.region_areas(mine).withColumnRenamed("area_deg2", "_all"), "region_id")
    named = shared.join(groups.select(F.col("region_id").alias("group_id"), "ord", *attributes), "group_id")
    order = F.struct(F.round(F.col("area_deg2") / F.col("_all"), overlay.DIGITS), -F.col("ord"))
    best = named.groupBy("region_id").agg(F.max_by(F.struct(*attributes), order).alias("_best"))
    placed = basins.join(best.select("region_id", "_best.*"), "region_id", "left")
    return placed.fillna("", subset=attributes)


def representative_points(regions: DataFrame) -> DataFrame:
    """``region_id, lon, lat``: a point inside each region, however small the region is."""
    return overlay.interior_points(region_edges(regions))


def assign_by_point(basins: DataFrame, groups: DataFrame, attributes: list[str]) -> DataFrame:
    """Each basin with the first group that contains its representative point."""
    points = representative_points(basins).withColumnRenamed("region_id", "basin_id")
    hit = assign_region(points, groups, attributes=tuple(attributes)).select(
        F.col("basin_id").alias("region_id"), *attributes
    )
    return basins.join(hit, "region_id", "left").fillna("", subset=attributes)


def assign_basins(basins: DataFrame, groups: DataFrame, attributes: list[str], method: str = "largest_overlap") -> DataFrame:
    """Basin-to-group assignment by ``largest_overlap`` or ``centroid``."""
    if method == "largest_overlap":
        return assign_largest_overlap(basins, groups, attributes)
    if method == "centroid":
        return assign_by_point(basins, groups, attributes)
    raise ValueError(f"unknown method {method!r}")


def box_layer(spark: SparkSession, box) -> DataFrame:
    """A bounding box as a region layer of one row."""
    corners = [(box.lon_min, box.lat_min), (box.lon_max, box.lat_min), (box.lon_max, box.lat_max), (box.lon_min, box.lat_max)]
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in [*corners, corners[0]]])
    return spark.range(1).select(F.col("id").cast("int").alias("region_id"), F.lit(0).alias("ord"), F.array(ring).alias("rings"))


def inside_bbox(basins: DataFrame, box, min_fraction: float = 0.5) -> DataFrame:
    """Basins with at least ``min_fraction`` of their area in the box.

    Adds ``overlap_frac``, the exact share in plain degrees.
    """
    edges = overlay.signed_edges(region_edges(basins))
    shared = overlay.overlap_areas(edges, overlay.signed_edges(region_edges(box_layer(basins.sparkSession, box))))
    share = shared.select("region_id", F.col("area_deg2").alias("_in")).join(overlay.region_areas(edges), "region_id")
    share = share.select("region_id", F.least(F.lit(1.0), F.col("_in") / F.col("area_deg2")).alias("overlap_frac"))
    return basins.join(share.where(F.round("overlap_frac", overlay.DIGITS) >= min_fraction), "region_id")


def domain_cells(regions: DataFrame, cell_deg: float = 0.05) -> DataFrame:
    """Distinct cells of the union of all regions."""
    return covered_cells(regions, cell_deg).select("cell_x", "cell_y").distinct()


# -- neighbours --------------------------------------------------------------


def segment_pieces(regions: DataFrame, piece_deg: float) -> DataFrame:
    """Edges cut into pieces no longer than ``piece_deg`` per axis."""
    edges = region_edges(regions)
    span = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    cuts = F.greatest(F.ceil(span / piece_deg), F.lit(1)).cast("int")
    cut = edges.withColumn("_n", cuts).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))

    def at(a: str, b: str, k: Column) -> Column:
        # Exact end points: neighbours cut the same border from either end.
        inner = F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")
        return F.when(k == F.col("_n"), F.col(b)).otherwise(inner)

    k = F.col("_k")
    return cut.select(
        "region_id",
        "ord",
        at("x1", "x2", k).alias("x1"),
        at("y1", "y2", k).alias("y1"),
        at("x1", "x2", k + 1).alias("x2"),
        at("y1", "y2", k + 1).alias("y2"),
    )


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance from a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    along = F.when(length2 == 0, F.lit(0.0)).otherwise(((px - x1) * dx + (py - y1) * dy) / length2)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segment_distance(a: list[Column], b: list[Column]) -> Column:
    """Planar distance between two segments, zero when they cross."""
    crossing = (_side(*a, b[0], b[1]) * _side(*a, b[2], b[3]) < 0) & (_side(*b, a[0], a[1]) * _side(*b, a[2], a[3]) < 0)
    ends = F.least(
        point_segment_distance(a[0], a[1], *b),
        point_segment_distance(a[2], a[3], *b),
        point_segment_distance(b[0], b[1], *a),
        point_segment_distance(b[2], b[3], *a),
    )
    return F.when(crossing, F.lit(0.0)).otherwise(ends)


def neighbour_pairs(regions: DataFrame, tolerance_deg: float = 0.005) -> DataFrame:
    """Unordered region pairs that touch, overlap or come closer than the tolerance.

    Border pieces meet in small cells; only pairs that pass the exact distance
    test leave the join. Nested regions are found by one border point each.
    """
    cell = 4 * tolerance_deg
    pieces = segment_pieces(regions, cell)

    def spread(lo: Column, hi: Column, margin: float) -> Column:
        return F.explode(F.sequence(cell_index(lo - margin, cell), cell_index(hi + margin, cell)))

    def keyed(margin: float) -> DataFrame:
        rows = pieces.select("*", spread(F.least("x1", "x2"), F.greatest("x1", "x2"), margin).alias("cell_x"))
        return rows.select("*", spread(F.least("y1", "y2"), F.greatest("y1", "y2"), margin).alias("cell_y"))

    left, right = keyed(tolerance_deg).alias("l"), keyed(0.0).alias("r")
    corners = [[F.col(f"{side}.{c}") for c in ("x1", "y1", "x2", "y2")] for side in ("l", "r")]
    near = left.join(
        right,
        (F.col("l.cell_x") == F.col("r.cell_x"))
        & (F.col("l.cell_y") == F.col("r.cell_y"))
        & (F.col("l.ord") < F.col("r.ord"))
        & (segment_distance(*corners) < tolerance_deg),
    ).select(F.col("l.region_id").alias("region_a"), F.col("r.region_id").alias("region_b"))
    order = regions.select("region_id", "ord")
    starts = regions.select(
        F.col("region_id").alias("inner_id"),
        F.col("ord").alias("inner_ord"),
        F.col("rings")[0][0]["lon"].alias("lon"),
        F.col("rings")[0][0]["lat"].alias("lat"),
    )
    nested = points_in_regions(starts, regions).where("region_id <> inner_id").join(order, "region_id")
    swap = F.col("inner_ord") < F.col("ord")
    contained = nested.select(
        F.when(swap, F.col("inner_id")).otherwise(F.col("region_id")).alias("region_a"),
        F.when(swap, F.col("region_id")).otherwise(F.col("inner_id")).alias("region_b"),
    )
    return near.unionByName(contained).distinct()
