"""Terrain statistics per region, elevation bands, passes and groups.

A pixel is ``(region_id, elev_m, pixel_area_m2)`` or, before the region join,
``(lon, lat, elev_m, pixel_area_m2)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from updraft.functions.air import clip
from updraft.operators import spatial
from updraft.operators.grids import stop_unless
from updraft.session import broadcast_if_small, cut_lineage

BIN_M = 100

# Class limits and names.
SIZE_CLASSES = [("small", 100.0), ("small_alpine", 500.0), ("liechti", 1500.0), ("large", 3000.0)]
SIZE_CLASS_TOP = "huge"
NORTH_OF, SOUTH_OF = 47.2, 46.2
LOWLAND_MAX_MEAN_M = 600.0
MIN_RELIEF_M = 400.0
BANDS = [("flachland", -1e4, 800.0), ("voralpen", 800.0, 1500.0), ("hochgebirge", 1500.0, 1e5)]
MIN_SEGMENT_KM2 = 50.0


def size_class(area_km2: Column) -> Column:
    """Half-open area classes."""
    label = F.when(area_km2 < SIZE_CLASSES[0][1], SIZE_CLASSES[0][0])
    for name, upper in SIZE_CLASSES[1:]:
        label = label.when(area_km2 < upper, name)
    return label.otherwise(SIZE_CLASS_TOP)


def size_band(area_km2: Column) -> Column:
    """Display bands; a missing area counts as 0."""
    area = F.coalesce(area_km2, F.lit(0.0))
    return F.when(area < 100, "<100").when(area < 500, "100–500").when(area < 1500, "500–1500").otherwise(">1500")


def n_side(lat: Column) -> Column:
    """North, centre or south of the main ridge."""
    return F.when(lat > NORTH_OF, "N").when(lat < SOUTH_OF, "S").otherwise("C")


def aspect_ratio(regions: DataFrame) -> DataFrame:
    """Adds long over short side of the bounding box in km; infinite when flat."""
    points = F.flatten("rings")
    lons, lats = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    boxed = regions.withColumns(
        {"_w": F.array_min(lons), "_e": F.array_max(lons), "_s": F.array_min(lats), "_n": F.array_max(lats)}
    )
    width = (F.col("_e") - F.col("_w")) * 111.0 * F.cos(F.radians((F.col("_s") + F.col("_n")) / 2))
    height = (F.col("_n") - F.col("_s")) * 111.0
    short = F.least(width, height)
    ratio = F.when(short > 0, F.greatest(width, height) / short).otherwise(F.lit(float("inf")))
    return boxed.withColumn("aspect_ratio", ratio).drop("_w", "_e", "_s", "_n")


def region_key(name: Column, code: Column) -> Column:
    """Group identifier: its code if it has one, else a slug of its name."""
    bare = F.trim(code)
    slug = F.substring(F.translate(name, " /", "_-"), 1, 40)
    return F.concat(F.lit("soiusa_"), F.when(bare != "", bare).otherwise(slug))


def normalise_group_names(groups: DataFrame, identifier: str = "osm_id") -> DataFrame:
    """Fills ``soiusa_name`` from the best name column, absent columns with ''."""
    have = groups.columns
    if "soiusa_name" in have:
        named = groups
    else:
        source = next((c for c in ("name_de", "name") if c in have), identifier)
        named = groups.withColumn("soiusa_name", F.coalesce(F.col(source).cast("string"), F.lit("")))
    for missing in ("soiusa_code", "osm_id"):
        if missing not in have:
            named = named.withColumn(missing, F.lit(""))
    return named


def log_scale_position(df: DataFrame, column: str = "area_km2") -> DataFrame:
    """Adds the position of log10(value) between the data's smallest and largest."""
    log = F.when(F.col(column) > 0, F.log10(column))
    bounded = df.withColumn("_span", df.select(F.struct(F.min(log).alias("lo"), F.max(log).alias("hi"))).scalar())
    lo, hi = F.col("_span.lo"), F.col("_span.hi")
    clipped = clip((log - lo) / (hi - lo), 0.0, 1.0)
    return bounded.withColumn("position", F.when(hi > lo, clipped)).drop("_span")


# -- pixels ------------------------------------------------------------------


def pixels_in_region(pixels: DataFrame, regions: DataFrame, require_all: bool = False) -> DataFrame:
    """Pixels with the regions that contain their centre.

    ``require_all`` stops the query when a region has no pixel; otherwise such
    regions are left out.
    """
    placed = spatial.points_in_regions(pixels, regions)
    if not require_all:
        return placed
    counts = placed.groupBy("region_id").agg(F.count("*").alias("_n"))
    checked = regions.select("region_id").join(counts, "region_id", "left")
    checked = checked.where(stop_unless(F.col("_n") > 0, "a region holds no terrain pixel"))
    return placed.join(broadcast_if_small(checked.select("region_id")), "region_id", "left_semi")


def area_height_distribution(pixels: DataFrame, bin_m: int = BIN_M) -> DataFrame:
    """Heated ground area and remaining air volume per height bin and region.

    Bins are dense from the lowest to the highest pixel and the last one is
    closed on the right. Pixels are counted per bin before the shuffle; all
    later steps work on that small table.
    """
    per_bin = pixels.groupBy("region_id", F.floor(F.col("elev_m") / bin_m).alias("bin")).agg(
        F.count("*").alias("n"), F.max("elev_m").alias("_max"), F.min("pixel_area_m2").alias("px")
    )
    region = W.partitionBy("region_id")
    staged = per_bin.withColumn("_lo", F.min("bin").over(region)).withColumn("_hi", F.max("bin").over(region))
    # A highest pixel exactly on an edge belongs to the bin below it.
    on_edge = (F.col("bin") == F.col("_hi")) & (F.col("_max") == F.col("bin") * bin_m) & (F.col("bin") > F.col("_lo"))
    settled = staged.withColumn("bin", F.when(on_edge, F.col("bin") - 1).otherwise(F.col("bin")))
    counted = settled.groupBy("region_id", "bin").agg(F.sum("n").alias("n"))
    bounds = settled.groupBy("region_id").agg(
        F.min("bin").alias("_lo"), F.max("bin").alias("_hi"), F.sum("n").alias("n_pixels"), F.min("px").alias("px")
    )
    dense = bounds.select("region_id", "n_pixels", "px", F.explode(F.sequence("_lo", "_hi")).alias("bin"))
    full = dense.join(counted, ["region_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upto = F.sum("n").over(W.partitionBy("region_id").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    above = F.col("n_pixels") - upto
    filled = F.col("px") * bin_m * (above + 0.5 * F.col("n"))
    return full.select(
        "region_id",
        (F.col("bin") * bin_m).cast("double").alias("z_bottom_m"),
        ((F.col("bin") + 1) * bin_m).cast("double").alias("z_top_m"),
        (F.col("n") * F.col("px")).alias("s_g_m2"),
        (F.col("n_pixels") * F.col("px") * bin_m - filled).alias("v_a_m3"),
    )


def zonal_stats(pixels: DataFrame) -> DataFrame:
    """Mean elevation, pixel count and area per region."""
    return pixels.groupBy("region_id").agg(
        F.avg("elev_m").alias("mean_elev_m"), F.count("*").alias("n_pixels"), F.sum("pixel_area_m2").alias("area_m2")
    )


def relief_columns(ahd: DataFrame) -> DataFrame:
    """Lowest occupied bin, relief over occupied bins, relief over all bins."""
    occupied = F.col("s_g_m2") > 0
    low, high = F.min(F.when(occupied, F.col("z_bottom_m"))), F.max(F.when(occupied, F.col("z_top_m")))
    return ahd.groupBy("region_id").agg(
        low.alias("elev_min_m"),
        (high - low).alias("elev_range_m"),
        (F.max("z_top_m") - F.min("z_bottom_m")).alias("full_range_m"),
    )


def habitat_class(mean_elev: Column) -> Column:
    return F.when(F.coalesce(mean_elev, F.lit(0.0)) > LOWLAND_MAX_MEAN_M, "alpine").otherwise("vorland")


def relief_class(relief: Column) -> Column:
    """Terrain type outside the mountains; unknown relief stays ``non_alpine``."""
    return F.when(relief >= MIN_RELIEF_M, "mittelgebirge").when(relief.isNotNull(), "flachland").otherwise("non_alpine")


def terrain_classes(regions: DataFrame, mountain_groups: DataFrame, relief: DataFrame) -> DataFrame:
    """Adds ``terrain_type``: alpine inside a mountain group, else by relief.

    Inside means that the region's representative point lies in a group.
    """
    points = spatial.representative_points(regions).withColumnRenamed("region_id", "_id")
    inside = spatial.assign_region(points, mountain_groups).where("region_id IS NOT NULL").select(
        F.col("_id").alias("region_id"), F.lit(True).alias("_alpine")
    )
    known = regions.join(inside, "region_id", "left").join(relief.select("region_id", "elev_range_m"), "region_id", "left")
    kind = F.when(F.col("_alpine"), "alpine").otherwise(relief_class(F.col("elev_range_m")))
    return known.withColumn("terrain_type", kind).drop("_alpine")


def annotate_regions(regions: DataFrame, stats: DataFrame, relief: DataFrame) -> DataFrame:
    """Joins zonal results to regions by text id and refines ``non_alpine`` rows."""
    key = F.col("region_id").cast("string")
    zonal = stats.select(key.alias("_id"), "mean_elev_m").join(
        relief.select(key.alias("_id"), F.col("full_range_m").alias("elev_range_m")), "_id", "left"
    )
    joined = regions.withColumn("_id", key).join(zonal, "_id", "left").drop("_id")
    with_habitat = joined.withColumn("habitat_class", habitat_class(F.col("mean_elev_m")))
    if "terrain_type" not in regions.columns:
        return with_habitat
    refined = F.when(F.col("terrain_type") != "non_alpine", F.col("terrain_type")).otherwise(
        relief_class(F.col("elev_range_m"))
    )
    return with_habitat.withColumn("terrain_type", refined)


def split_candidate() -> Column:
    """Tall, valley-reaching and long or large; missing inputs mean no."""
    tall = (F.col("elev_range_m") > 2000) & (F.col("elev_min_m") < 800)
    return F.coalesce(tall & ((F.col("aspect_ratio") > 2) | (F.col("area_km2") > 1500)), F.lit(False))


def split_candidates(regions: DataFrame) -> DataFrame:
    return regions.where(split_candidate())


def band_of(elev: Column) -> Column:
    label = F.when((elev >= BANDS[0][1]) & (elev < BANDS[0][2]), BANDS[0][0])
    for name, lo, hi in BANDS[1:]:
        label = label.when((elev >= lo) & (elev < hi), name)
    return label


def elevation_bands(pixels: DataFrame, regions: DataFrame, min_km2: float = MIN_SEGMENT_KM2) -> tuple[DataFrame, DataFrame]:
    """Splits candidate regions by height: ``(segments, band_map)``.

    A band below ``min_km2`` joins the region's largest. A region left with one
    band, and every region without the ``candidate`` flag, stays whole.
    ``segments`` has the largest band's own area (``area_km2``) and the area
    with absorbed bands (``area_total_km2``). ``band_map`` maps each region's
    bands to segment ids, for labelling pixels.
    """
    chosen = regions.where("candidate").select("region_id")
    per_band = (
        pixels.join(broadcast_if_small(chosen), "region_id", "left_semi")
        .groupBy("region_id", band_of(F.col("elev_m")).alias("band"))
        .agg((F.sum("pixel_area_m2") / 1e6).alias("_area"))
        .where("band IS NOT NULL")
    )
    names = F.array(*[F.lit(b[0]) for b in BANDS])
    region = W.partitionBy("region_id")
    ranked = per_band.withColumn("_rank", F.array_position(names, F.col("band")))
    largest = F.max(F.struct(F.col("_area"), -F.col("_rank"))).over(region)
    ranked = ranked.withColumn("_top", F.element_at(names, (-largest["col2"]).cast("int")))
    target = F.when((F.col("_area") < min_km2) & (F.col("band") != F.col("_top")), F.col("_top")).otherwise(F.col("band"))
    merged = ranked.withColumn("target", target).withColumn("_kinds", F.size(F.collect_set("target").over(region)))
    split = merged.where("_kinds > 1").withColumn("segment_id", F.concat_ws("_", F.col("region_id").cast("string"), "target"))
    segments = split.groupBy("region_id", "segment_id", F.col("target").alias("band")).agg(
        F.sum(F.when(F.col("band") == F.col("target"), F.col("_area"))).alias("area_km2"),
        F.sum("_area").alias("area_total_km2"),
    )
    whole = regions.join(split.select("region_id").distinct(), "region_id", "left_anti").select(
        "region_id", F.col("region_id").cast("string").alias("segment_id"), F.lit("whole").alias("band"),
        F.col("area_km2"), F.col("area_km2").alias("area_total_km2"),
    )
    return segments.unionByName(whole), split.select("region_id", "band", "segment_id")


def label_pixels(pixels: DataFrame, band_map: DataFrame) -> DataFrame:
    """Pixels with the segment they fall in; whole regions use their own id."""
    keyed = pixels.withColumn("band", band_of(F.col("elev_m")))
    joined = keyed.join(broadcast_if_small(band_map), ["region_id", "band"], "left")
    return joined.withColumn("segment_id", F.coalesce("segment_id", F.col("region_id").cast("string"))).drop("band")


# -- passes ------------------------------------------------------------------


def border_minimum(pixels: DataFrame, regions: DataFrame, pairs: DataFrame, tolerance_deg: float = 0.005) -> DataFrame:
    """Lowest pixel close to the borders of both regions of each pair.

    Each pixel looks up the border pieces around its cell, forms the few pairs
    of regions it is close to, and only ``(pair, minimum)`` is shuffled.
    """
    cell = 4 * tolerance_deg
    pieces = spatial.segment_pieces(regions, cell)

    def spread(lo: Column, hi: Column) -> Column:
        index = spatial.cell_index
        return F.explode(F.sequence(index(lo - tolerance_deg, cell), index(hi + tolerance_deg, cell)))

    keyed = pieces.select("*", spread(F.least("x1", "x2"), F.greatest("x1", "x2")).alias("cell_x"))
    keyed = keyed.select("*", spread(F.least("y1", "y2"), F.greatest("y1", "y2")).alias("cell_y"))
    borders = keyed.groupBy("cell_x", "cell_y").agg(
        F.collect_list(F.struct("region_id", "x1", "y1", "x2", "y2")).alias("_pieces")
    )
    lon, lat = F.col("lon"), F.col("lat")
    placed = pixels.where("elev_m > -500").select(
        "lon", "lat", "elev_m",
        spatial.cell_index(lon, cell).alias("cell_x"), spatial.cell_index(lat, cell).alias("cell_y"),
    )
    # Rows are arrays of pieces: left to the planner, which knows their bytes.
    met = placed.join(borders, ["cell_x", "cell_y"])
    close = F.filter(
        "_pieces",
        lambda s: spatial.point_segment_distance(lon, lat, s["x1"], s["y1"], s["x2"], s["y2"]) <= tolerance_deg,
    )
    ids = F.array_distinct(F.transform(close, lambda s: s["region_id"]))
    near = met.select("elev_m", ids.alias("_ids")).where(F.size("_ids") >= 2)
    sided = near.select("elev_m", "_ids", F.explode("_ids").alias("region_a"))
    both = sided.select("elev_m", "region_a", F.explode("_ids").alias("region_b"))
    # Minima merge before the shuffle, so only pairs of regions are joined.
    lowest = both.groupBy("region_a", "region_b").agg(F.min("elev_m").alias("threshold_z_m"))
    asked = pairs.select("region_a", "region_b")
    return lowest.join(asked, ["region_a", "region_b"], "left_semi")


def pass_height(
    pairs: DataFrame, pixels: DataFrame, regions: DataFrame, relief: DataFrame, tolerance_deg: float = 0.005
) -> DataFrame:
    """Pass height between neighbours above the higher of their valley floors.

    A region without a known floor takes the pass height itself. Pairs without
    a pixel on their border are left out.
    """
    lowest = border_minimum(pixels, regions, pairs, tolerance_deg)
    floors = relief.select("region_id", "elev_min_m")

    def floor_of(side: str) -> DataFrame:
        return floors.select(F.col("region_id").alias(f"region_{side}"), F.col("elev_min_m").alias(f"_floor_{side}"))

    joined = lowest.join(floor_of("a"), "region_a", "left").join(floor_of("b"), "region_b", "left")
    z = F.col("threshold_z_m")
    filled = joined.withColumn("valley_floor_a_m", F.coalesce("_floor_a", z)).withColumn(
        "valley_floor_b_m", F.coalesce("_floor_b", z)
    )
    above = z - F.greatest("valley_floor_a_m", "valley_floor_b_m")
    return filled.select(
        "region_a", "region_b", "threshold_z_m", "valley_floor_a_m", "valley_floor_b_m",
        F.greatest(F.lit(0.0), above).alias("relative_threshold_m"),
    )


# -- groups, tiles, refinement -----------------------------------------------


def realise_groups(basins: DataFrame, groups: DataFrame) -> DataFrame:
    """One region per group with basins, groups without any kept from source.

    ``basins`` carry ``region_id, area_km2, soiusa_name, soiusa_code, osm_id``,
    the name empty where no group holds the basin.
    """
    taken = basins.where("soiusa_name <> ''").groupBy("soiusa_name").agg(
        F.min_by(F.struct("soiusa_code", "osm_id"), "region_id").alias("_first"),
        F.count("*").alias("n_basins"),
        F.sum("area_km2").alias("area_km2"),
    )
    realised = taken.select("soiusa_name", "_first.soiusa_code", "_first.osm_id", "n_basins", "area_km2")
    bare = normalise_group_names(groups).where("soiusa_name <> ''").join(taken, "soiusa_name", "left_anti").select(
        "soiusa_name", "soiusa_code", "osm_id", F.lit(0).cast("long").alias("n_basins"),
        F.lit(None).cast("double").alias("area_km2"),
    )
    key = region_key(F.col("soiusa_name"), F.col("soiusa_code"))
    return realised.unionByName(bare).withColumn("region_id", key).withColumn("terrain_type", F.lit("alpine"))


def regions_with_rest(basins: DataFrame, groups: DataFrame) -> DataFrame:
    """Realised groups plus every unassigned basin as a region of its own."""
    rest = basins.where("soiusa_name = ''").select(
        F.concat(F.lit("hb8_"), F.col("region_id").cast("string")).alias("region_id"), "soiusa_name", "soiusa_code",
        "osm_id", F.lit(1).cast("long").alias("n_basins"), "area_km2", F.lit("non_alpine").alias("terrain_type"),
    )
    return realise_groups(basins, groups).unionByName(rest)


def tile_cover(bounds: DataFrame) -> DataFrame:
    """One-degree elevation tiles of each box ``min_lon, min_lat, max_lon, max_lat``."""

    def degrees(lo: str, hi: str) -> Column:
        first, last = F.floor(lo), F.ceil(hi) - 1
        return F.when(first <= last, F.sequence(first, F.greatest(first, last)))

    rows = bounds.select("*", F.explode(degrees("min_lat", "max_lat")).alias("tile_lat"))
    tiles = rows.select("*", F.explode(degrees("min_lon", "max_lon")).alias("tile_lon"))
    name = F.concat(
        F.lit("Copernicus_DSM_COG_10_"), F.when(F.col("tile_lat") >= 0, "N").otherwise("S"),
        F.lpad(F.abs("tile_lat").cast("string"), 2, "0"), F.lit("_00_"),
        F.when(F.col("tile_lon") >= 0, "E").otherwise("W"), F.lpad(F.abs("tile_lon").cast("string"), 3, "0"),
        F.lit("_00_DEM"),
    )
    return tiles.withColumn("tile", name)


def missing_tiles(needed: DataFrame, cached: DataFrame) -> DataFrame:
    """Needed tiles without a cached copy."""
    return needed.select("tile").distinct().join(cached.select("tile"), "tile", "left_anti")


def refine_region(basins: DataFrame, seed_box, min_fraction: float = 0.5, clip=None, cell_deg: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Region grown from the basins that overlap a seed box: ``(cells, provenance)``.

    ``clip`` limits the cells to a box. The provenance has a row per basin used;
    no basin at all is an error.
    """
    chosen = spatial.inside_bbox(basins, seed_box, min_fraction)
    cells = spatial.domain_cells(chosen, cell_deg)
    if clip is not None:
        x, y = (F.col("cell_x") + 0.5) * cell_deg, (F.col("cell_y") + 0.5) * cell_deg
        cells = cells.where(x.between(clip.lon_min, clip.lon_max) & y.between(clip.lat_min, clip.lat_max))
    counted = chosen.agg(F.count("*").alias("n_basins"))
    n_basins = counted.where(stop_unless(F.col("n_basins") > 0, "no basin overlaps the seed box")).scalar()
    provenance = chosen.select(F.col("region_id").alias("basin_id"), n_basins.alias("n_basins"))
    return cells.where(n_basins > 0), provenance
