"""Exact areas and interior points of polygons, as work on a table of edges.

Every edge gets a sign so that, along any horizontal line, the signed edges east
of a point add up to one inside the region and to zero outside. A region is then
a signed sum of strips, each all that lies west of one edge, and the area that
two regions share is the signed sum over pairs of edges of what their strips
share: an integral over the heights that both edges span of the lesser of two
straight lines, which has a closed form. Holes, several parts and any direction
of the rings need no special care, and no polygon is ever cut or assembled.

Edges meet by region and band of latitude. Areas are in square degrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Height of the bands in which edges meet, width of the cells in which bounding boxes meet.
BAND_DEG, BOX_DEG = 0.25, 1.0
#: Decimals to which shares of a region and widths are told apart.
DIGITS = 9
#: Width in degrees of what counts as no overlap: rounding stays far below it, real overlaps far above.
NO_WIDTH_DEG = 1e-12


def _span(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(low / F.lit(width)), F.floor(high / F.lit(width))))


def crosses_at(y: Column, y1: Column, y2: Column) -> Column:
    """Whether an edge crosses the height; an end point counts for the upper edge only."""
    return (y1 > y) != (y2 > y)


def x_at(y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return x1 + (y - y1) * (x2 - x1) / (y2 - y1)


def _rings(edges: DataFrame) -> DataFrame:
    """Direction, extent and nesting depth of each ring."""
    turned = (F.col("x1") - F.col("west")) * F.col("y2") - (F.col("x2") - F.col("west")) * F.col("y1")
    # The middle of the tallest edge stands for the ring: rings that only touch do so at corners.
    middle = F.struct(((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    rings = edges.groupBy("region_id", "ring_id").agg(
        F.signum(F.sum(turned)).alias("turn"),
        F.max_by(middle, F.struct(F.abs(F.col("y2") - F.col("y1")), "x1", "y1")).alias("probe"),
        F.min("y1").alias("low"),
        F.max("y1").alias("high"),
    )
    several = rings.groupBy("region_id").agg(F.count("*").alias("n")).where("n > 1").select("region_id")
    probes = rings.join(several, "region_id", "left_semi").select(
        "region_id", F.col("ring_id").alias("_ring"), "probe", F.floor(F.col("probe.y") / BAND_DEG).alias("band")
    )
    placed = edges.join(several, "region_id", "left_semi").where("y1 <> y2")
    placed = placed.select("*", _span(F.least("y1", "y2"), F.greatest("y1", "y2"), BAND_DEG).alias("band"))
    y = F.col("probe.y")
    east = crosses_at(y, F.col("y1"), F.col("y2")) & (F.col("probe.x") < x_at(y, *map(F.col, ("x1", "y1", "x2", "y2"))))
    around = probes.join(placed, ["region_id", "band"]).where((F.col("ring_id") != F.col("_ring")) & east)
    depth = around.groupBy("region_id", F.col("_ring").alias("ring_id")).agg((F.count("*") % 2).alias("depth"))
    return rings.join(depth, ["region_id", "ring_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def signed_edges(edges: DataFrame) -> DataFrame:
    """``edges`` that are not level, with ``sign``: 1 where the region lies west of the edge, -1 where east."""
    rings = _rings(edges).select("region_id", "ring_id", (F.col("turn") * (1 - 2 * F.col("depth"))).alias("turn"))
    upward = F.when(F.col("y2") > F.col("y1"), F.col("turn")).otherwise(-F.col("turn"))
    return edges.where("y1 <> y2").join(rings, ["region_id", "ring_id"]).withColumn("sign", upward.cast("double")).drop("turn")


def region_areas(signed: DataFrame) -> DataFrame:
    """region_id and area_deg2."""
    strip = F.abs(F.col("y2") - F.col("y1")) * ((F.col("x1") + F.col("x2")) / 2 - F.col("west"))
    return signed.groupBy("region_id").agg(F.sum(F.col("sign") * strip).alias("area_deg2"))


def _boxes(signed: DataFrame, name: str) -> DataFrame:
    """Bounding boxes, once for each coarse cell that they reach."""
    ends = [F.min(F.least(f"{c}1", f"{c}2")).alias(f"{c}_lo") for c in "xy"] + [F.max(F.greatest(f"{c}1", f"{c}2")).alias(f"{c}_hi") for c in "xy"]
    box = signed.groupBy(F.col("region_id").alias(name)).agg(*ends)
    wide = box.select("*", _span(F.col("x_lo"), F.col("x_hi"), BOX_DEG).alias("cell_x"))
    return wide.select("*", _span(F.col("y_lo"), F.col("y_hi"), BOX_DEG).alias("cell_y"))


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Regions of the two layers whose bounding boxes overlap: ids, the common heights and a west end."""
    left, right = _boxes(a, "region_id").alias("l"), _boxes(b, "group_id").alias("r")
    overlap = [(F.col(f"l.{c}_lo") < F.col(f"r.{c}_hi")) & (F.col(f"r.{c}_lo") < F.col(f"l.{c}_hi")) for c in "xy"]
    met = left.join(right, ["cell_x", "cell_y"]).where(overlap[0] & overlap[1])
    return met.select(
        "region_id",
        "group_id",
        F.greatest("l.y_lo", "r.y_lo").alias("y_lo"),
        F.least("l.y_hi", "r.y_hi").alias("y_hi"),
        F.greatest("l.x_lo", "r.x_lo").alias("x_base"),
    ).distinct()


def _shared_strip() -> Column:
    """Integral of the lesser of two edges' longitudes, counted from ``x_base``, over their common heights."""
    lo = F.greatest(F.least("l.y1", "l.y2"), F.least("r.y1", "r.y2"))
    hi = F.least(F.greatest("l.y1", "l.y2"), F.greatest("r.y1", "r.y2"))

    def at(y: Column, side: str) -> Column:
        return x_at(y, *[F.col(f"{side}.{c}") for c in ("x1", "y1", "x2", "y2")]) - F.col("x_base")

    (p1, p2), (q1, q2) = [(at(lo, side), at(hi, side)) for side in ("l", "r")]
    d1, d2 = p1 - q1, p2 - q2
    low1, low2 = F.least(p1, q1), F.least(p2, q2)
    share = d1 / (d1 - d2)  # where the lines cross, if they do
    meet = p1 + share * (p2 - p1)
    bent = share * (low1 + meet) / 2 + (1 - share) * (meet + low2) / 2
    return (hi - lo) * F.when(d1 * d2 < 0, bent).otherwise((low1 + low2) / 2)


def overlap_areas(a: DataFrame, b: DataFrame) -> DataFrame:
    """region_id of ``a``, group_id of ``b`` and the area_deg2 that they share, where there is any.

    Both arguments are signed edges.
    """
    columns = ("x1", "y1", "x2", "y2", "sign")
    pairs = _pairs(a, b)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    left = a.select("region_id", *columns).join(pairs, "region_id").where((low < F.col("y_hi")) & (high > F.col("y_lo")))
    left = left.select("*", _span(F.greatest(low, F.col("y_lo")), F.least(high, F.col("y_hi")), BAND_DEG).alias("band"))
    right = b.select(F.col("region_id").alias("group_id"), *columns)
    right = right.select("*", _span(low, high, BAND_DEG).alias("band"))
    met = left.alias("l").join(right.alias("r"), ["group_id", "band"])
    lo = F.greatest(F.least("l.y1", "l.y2"), F.least("r.y1", "r.y2"))
    hi = F.least(F.greatest("l.y1", "l.y2"), F.greatest("r.y1", "r.y2"))
    # Two edges may share several bands; the one where their common heights begin counts.
    met = met.where((lo < hi) & (F.floor(lo / BAND_DEG) == F.col("band")))
    area = F.sum(F.col("l.sign") * F.col("r.sign") * _shared_strip())
    shared = met.groupBy("region_id", "group_id").agg(area.alias("area_deg2"), F.max(F.col("y_hi") - F.col("y_lo")).alias("_height"))
    return shared.where(F.col("area_deg2") > NO_WIDTH_DEG * F.col("_height")).drop("_height")


def interior_points(edges: DataFrame) -> DataFrame:
    """region_id, lon, lat of a point inside each region that has an area.

    Each part is cut at one height: midway between the corners of the region next
    below and above the part's middle, so that no corner lies on the line. The
    point is the middle of the widest piece of these lines that is inside.
    """
    parts = _rings(edges).where("depth = 0 AND turn <> 0")
    centres = parts.select("region_id", ((F.col("low") + F.col("high")) / 2).alias("y"), F.lit(None).cast("double").alias("corner"))
    corners = edges.select("region_id", F.col("y1").alias("y"), F.col("y1").alias("corner"))
    upward = W.partitionBy("region_id").orderBy("y", F.col("corner").isNull())
    below = F.last("corner", ignorenulls=True).over(upward.rowsBetween(W.unboundedPreceding, 0))
    above = F.first("corner", ignorenulls=True).over(upward.rowsBetween(1, W.unboundedFollowing))
    lines = corners.unionByName(centres).select("region_id", "corner", ((below + above) / 2).alias("y"))
    lines = lines.where("corner IS NULL AND y IS NOT NULL").select("region_id", "y").distinct()
    lines = lines.withColumn("band", F.floor(F.col("y") / BAND_DEG))
    placed = edges.where("y1 <> y2").select("region_id", "x1", "y1", "x2", "y2", _span(F.least("y1", "y2"), F.greatest("y1", "y2"), BAND_DEG).alias("band"))
    cut = lines.join(placed, ["region_id", "band"]).where(crosses_at(F.col("y"), F.col("y1"), F.col("y2")))
    cut = cut.select("region_id", "y", x_at(F.col("y"), *map(F.col, ("x1", "y1", "x2", "y2"))).alias("x"))
    along = W.partitionBy("region_id", "y").orderBy("x")
    pieces = cut.withColumn("_i", F.row_number().over(along)).withColumn("_end", F.lead("x").over(along)).where("_i % 2 = 1")
    width = F.round(F.col("_end") - F.col("x"), DIGITS)
    middle = F.struct(((F.col("x") + F.col("_end")) / 2).alias("lon"), F.col("y").alias("lat"))
    best = pieces.groupBy("region_id").agg(F.max_by(middle, F.struct(width, -F.col("y"), -F.col("x"))).alias("p"))
    return best.select("region_id", "p.lon", "p.lat")
