"""Gridded forecast fields: regional series, gates, completeness.

A grid row is ``(init_h | init, lead_h, var, lat_i, lon_i, lat, lon, value)``.
Missing values are null, never NaN.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from updraft.functions.air import potential_temperature, standard_pressure
from updraft.operators.spatial import points_in_regions, representative_points
from updraft.session import broadcast_if_small, cut_lineage

CELL = ["lat_i", "lon_i"]

# Surface and profile variables of the forecast archive.
SURFACE_VARS = (
    "t_2m", "td_2m", "t_g", "relhum_2m", "asob_s", "athb_s", "ashfl_s", "alhfl_s", "clct_mod",
    "hbas_sc", "htop_sc", "htop_dc", "cape_ml", "cin_ml", "hzerocl", "mh", "tot_prec",
)
PROFILE_VARS = ("t", "qv", "u", "v", "w", "tke")
INIT_HOURS = (0, 3, 6, 9, 12, 15, 18, 21)
MAX_LEAD = 48
N_LEVELS = 65
PROFILE_LEADS = (1, 12)
FILE_URL = "https://opendata.dwd.de/weather/nwp/icon-d2/grib"
FILE_STEM = "icon-d2_germany_regular-lat-lon"


def null_if_nan(df: DataFrame, *columns: str) -> DataFrame:
    """NaN becomes null once, at ingest."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})


def stop_unless(condition: Column, message: str) -> Column:
    """True where the condition holds; stops the query otherwise."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


# -- regions over the grid ---------------------------------------------------


def region_cell_map(cells: DataFrame, regions: DataFrame, require_all: bool = True) -> DataFrame:
    """Grid cells whose centre lies in each region; a region without any is an error."""
    mapped = points_in_regions(cells.select(*CELL, "lat", "lon").distinct(), regions)
    if not require_all:
        return mapped.select("region_id", *CELL)
    counts = mapped.groupBy("region_id").agg(F.count("*").alias("_n"))
    checked = regions.select("region_id").join(counts, "region_id", "left")
    checked = checked.where(stop_unless(F.col("_n") > 0, "a region holds no grid cell"))
    return mapped.join(checked.select("region_id"), "region_id", "left_semi").select("region_id", *CELL)


def region_mean(grid: DataFrame, cell_map: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over a region's cells that hold a value."""
    joined = grid.join(broadcast_if_small(cell_map), CELL)
    return joined.groupBy("region_id", *keys).agg(F.avg("value").alias("mean"))


def nearest_rows(points: DataFrame, targets: DataFrame, key: str, dims: list[str], width: float = 0.25) -> DataFrame:
    """Each point's key with all columns of the nearest target, in the plane or on the line of ``dims``.

    Points and targets meet in bins: a point looks into its own bin and those
    around it. What it finds within a bin's width is its nearest, since nothing
    nearer can lie further off. Only points without such a find go on, with bins
    of twice the width, so the work follows the points and never their product
    with the targets. Of targets at one distance the least coordinates win. Points
    with a null coordinate have no nearest target.
    """
    rest = points.select(key, *dims).where(" AND ".join(f"{d} IS NOT NULL" for d in dims))
    values = targets.where(" AND ".join(f"{d} IS NOT NULL" for d in dims))
    ends = rest.select(*dims).unionByName(values.select(*dims)).agg(*[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    span = max((x or 0.0) for x in ends)
    columns = values.columns
    others = [F.col(f"_t.{d}").alias(f"_{d}") for d in dims]
    parts = []
    while True:
        bins = [F.floor(F.col(d) / F.lit(width)) for d in dims]
        placed = values.select(F.struct(*columns).alias("_t"), *[b.alias(f"_b{i}") for i, b in enumerate(bins)])
        asked = rest
        for i, b in enumerate(bins):
            asked = asked.select("*", F.explode(F.sequence(b - 1, b + 1)).alias(f"_b{i}"))
        met = asked.join(placed, [f"_b{i}" for i in range(len(dims))])
        square = sum((F.pow(F.col(d) - F.col(f"_t.{d}"), 2) for d in dims), F.lit(0.0))
        best = met.select(key, F.struct(square.alias("square"), *others, F.col("_t")).alias("_best")).groupBy(key).agg(F.min("_best").alias("_best"))
        last = width >= span
        best = cut_lineage(best if last else best.where(F.col("_best.square") <= width * width), "nearest")
        parts.append(best.select(key, *[F.col(f"_best._t.{c}").alias(c) for c in columns]))
        if last:
            break
        rest = cut_lineage(rest.join(best, key, "left_anti"), "rest")
        if rest.isEmpty():
            break
        width *= 2
    return reduce(DataFrame.unionByName, parts)


def nearest_cell(cells: DataFrame, points: DataFrame, key: str = "region_id") -> DataFrame:
    """Nearest grid row and column of each point, chosen independently."""
    axes = [("lat", "lat_i"), ("lon", "lon_i")]
    rows, columns = [nearest_rows(points, cells.select(*axis).distinct(), key, [axis[0]]).drop(axis[0]) for axis in axes]
    return rows.join(columns, key)


def nearest_grid_point(cells: DataFrame, points: DataFrame, key: str = "region_id") -> DataFrame:
    """Nearest cell of each point on a grid of any shape, rows and columns not being parallels and meridians."""
    return nearest_rows(points, cells.select("lat", "lon", *CELL).distinct(), key, ["lat", "lon"]).select(key, *CELL)


def scaffold(base: DataFrame, leads: tuple[int, int], variables: tuple[str, ...]) -> DataFrame:
    """Every base row at every lead and variable."""
    with_leads = base.select("*", F.explode(F.sequence(F.lit(leads[0]), F.lit(leads[1]))).alias("lead_h"))
    return with_leads.select("*", F.explode(F.array(*[F.lit(v) for v in variables])).alias("var"))


def surface_series(
    grid: DataFrame,
    regions: DataFrame,
    leads: tuple[int, int],
    variables: tuple[str, ...],
    run: str = "init_h",
    require_all: bool = True,
) -> DataFrame:
    """Value at the centre cell and mean over the region, per run, lead and variable.

    Absent fields come out as null rows, so every series is complete. A region
    without grid cells is an error, or left out when ``require_all`` is off.
    """
    # The cells of each run and the region map are static and small next to the
    # fields: stored once, so the fields are not scanned again for them.
    run_cells = cut_lineage(grid.select(run, *CELL, "lat", "lon").distinct(), "cells")
    cells = run_cells.drop(run).distinct()
    cell_map = cut_lineage(region_cell_map(cells, regions, require_all), "cell-map")
    centre = nearest_cell(cells, representative_points(regions))
    keys = [run, "lead_h", "var"]
    wanted = grid.where(F.col("var").isin(*variables) & F.col("lead_h").between(*leads))
    # One map for both: a cell may count for the mean, be the centre, or both.
    flags = [(cell_map, True, False), (centre, False, True)]
    marked = [m.select("region_id", *CELL, F.lit(a).alias("_in"), F.lit(b).alias("_centre")) for m, a, b in flags]
    parts = marked[0].unionByName(marked[1]).groupBy("region_id", *CELL)
    parts = cut_lineage(parts.agg(F.max("_in").alias("_in"), F.max("_centre").alias("_centre")), "parts")
    joined = wanted.join(broadcast_if_small(parts), CELL).groupBy("region_id", *keys)
    values = joined.agg(
        F.max(F.when(F.col("_centre"), F.col("value"))).alias("centroid"), F.avg(F.when(F.col("_in"), F.col("value"))).alias("mean")
    )
    every = run_cells.join(broadcast_if_small(cell_map), CELL).select(run, "region_id").distinct()
    return scaffold(every, leads, variables).join(values, ["region_id", *keys], "left")


def wide_series(series: DataFrame, variables: tuple[str, ...], keys: list[str]) -> DataFrame:
    """One row per lead, columns ``<var>_centroid`` and ``<var>_mean``."""
    cells = []
    for var in variables:
        for kind in ("centroid", "mean"):
            cells.append(F.max(F.when(F.col("var") == var, F.col(kind))).alias(f"{var}_{kind}"))
    return series.groupBy(*keys).agg(*cells)


def profile_heights(half_levels: DataFrame, keys: list[str]) -> DataFrame:
    """Full-level heights, midway between neighbouring half levels."""
    order = W.partitionBy(*keys).orderBy("level")
    middle = (F.col("height_m") + F.lead("height_m").over(order)) / 2
    below = F.lead("level").over(order).isNotNull()
    return half_levels.select(*keys, "level", middle.alias("height_m"), below.alias("_full")).where("_full").drop("_full")


def build_profile(
    levels: DataFrame, centre: DataFrame, heights: DataFrame, keys: list[str], variables: tuple[str, ...] = ("t", "qv")
) -> DataFrame:
    """Profile at each region's centre cell with heights and potential temperature.

    ``levels`` are grid rows with a ``level``; ``heights`` is keyed by region and
    level. ``step`` numbers the levels from the surface up.
    """
    at_centre = levels.join(broadcast_if_small(centre), CELL)
    values = [F.max(F.when(F.col("var") == v, F.col("value"))).alias(v) for v in variables]
    wide = at_centre.groupBy("region_id", *keys, "level").agg(*values)
    placed = wide.join(heights.select("region_id", "level", "height_m"), ["region_id", "level"])
    upward = W.partitionBy("region_id", *keys).orderBy("height_m")
    theta = potential_temperature(F.col("t"), standard_pressure(F.col("height_m")))
    return placed.withColumn("step", F.row_number().over(upward) - 1).withColumn("theta_k", theta)


# -- fluxes ------------------------------------------------------------------


def deaverage(series: DataFrame, keys: list[str], value: str = "mean", lead: str = "lead_s") -> DataFrame:
    """Mean since the start of the run turned into the mean of each interval.

    The first interval is 0. A missing value empties its own and the next
    interval. A series must start at lead 0 and hold each lead once.
    """
    order = W.partitionBy(*keys).orderBy(lead)
    t, before_t = F.col(lead), F.lag(lead).over(order)
    total = F.when(t == 0, F.lit(0.0)).otherwise(F.col(value) * t)
    staged = series.withColumn("_before_t", before_t).withColumn("_total", total)
    in_order = F.when(F.col("_before_t").isNull(), t == 0).otherwise(t > F.col("_before_t"))
    staged = staged.where(stop_unless(in_order, "a series must start at lead 0 and ascend"))
    step = (F.col("_total") - F.lag("_total").over(order)) / (t - F.col("_before_t"))
    flux = F.when(F.col("_before_t").isNull(), F.lit(0.0)).otherwise(step)
    return staged.withColumn("flux", flux).drop("_before_t", "_total")


def to_model_flux(wide: DataFrame, source: str = "turbulent", fraction: float = 0.3) -> DataFrame:
    """Upward sensible and latent flux from de-averaged columns.

    ``turbulent`` flips the sign of the downward-positive fluxes; ``radiation``
    takes a share of the net shortwave flux. Missing latent flux counts as 0.
    """
    if source == "turbulent":
        sensible = -F.col("ashfl_s")
        latent = F.coalesce(-F.col("alhfl_s"), F.lit(0.0)) if "alhfl_s" in wide.columns else F.lit(0.0)
    elif source == "radiation":
        sensible, latent = F.col("asob_s") * fraction, F.lit(0.0)
    else:
        raise ValueError(f"unknown flux source {source!r}")
    return wide.withColumn("sensible_w_m2", sensible).withColumn("latent_w_m2", latent)


# -- archive fields ----------------------------------------------------------


def stack_fields(grid: DataFrame, leads: tuple[int, int], variables: tuple[str, ...], run: str = "init_h") -> DataFrame:
    """Complete (run, lead, variable, cell) table with nulls for gaps, keyed by lead."""
    cells = grid.select(run, *CELL, "lat", "lon").distinct()
    full = scaffold(cells, leads, variables)
    values = grid.select(run, "lead_h", "var", *CELL, "value")
    return full.join(values, [run, "lead_h", "var", *CELL], "left")


def dedup_valid_time(grid: DataFrame, policy: str = "first", run: str = "init_h", sequence: str | None = None) -> DataFrame:
    """One value per variable, cell and valid hour where runs overlap.

    ``first`` keeps the run appended first, ``latest_init`` the newest run.
    Aggregates merge before the shuffle, so no window per cell is needed.
    """
    order = F.col(sequence or run)
    pick = {"first": F.min_by, "latest_init": F.max_by}
    if policy not in pick:
        raise ValueError(f"unknown policy {policy!r}")
    timed = grid.withColumn("valid_h", F.col(run) + F.col("lead_h"))
    chosen = pick[policy](F.struct(run, "lead_h", "value"), order).alias("_row")
    kept = timed.groupBy("var", *CELL, "valid_h").agg(chosen)
    return kept.select("var", *CELL, "valid_h", f"_row.{run}", "_row.lead_h", "_row.value")


def spatial_max_series(grid: DataFrame, variables: tuple[str, ...], hours_back: int | None = 72) -> DataFrame:
    """Per variable and valid hour the largest value of all cells, latest hours only."""
    kept = grid.where(F.col("var").isin(*variables))
    if hours_back is not None:
        latest = grid.select(F.max("valid_h")).scalar()
        kept = kept.where(F.col("valid_h") >= latest - hours_back)
    finite = F.when(~F.isnan("value"), F.col("value"))
    return kept.groupBy("var", "valid_h").agg(F.max(finite).alias("value")).where("value IS NOT NULL")


# -- the good-day gate -------------------------------------------------------


@dataclass(frozen=True)
class GateThresholds:
    """Cell thresholds and coverage shares of the three branches (fixed values)."""

    cape_cell: float = 500.0
    cape_cover_frac: float = 0.10
    rad_cell: float = 600.0
    rad_cover_frac: float = 0.25
    precip_wet_cell_mm: float = 1.0
    precip_wet_max_frac: float = 0.10
    htop_dc_cell_min_m: float = 2500.0
    htop_dc_cover_frac: float = 0.20

    def cells(self) -> dict[str, float]:
        return {"cape_ml": self.cape_cell, "asob_s": self.rad_cell, "htop_dc": self.htop_dc_cell_min_m}


GATE_LEADS = (1, 6)


def coverage(
    grid: DataFrame, thresholds: dict[str, float], leads: tuple[int, int] = GATE_LEADS, run: str = "init_h"
) -> DataFrame:
    """Largest share of cells above the threshold over the leads, per variable."""
    limit = F.when(F.col("var") == "", F.lit(None).cast("double"))
    for var, value in thresholds.items():
        limit = limit.when(F.col("var") == var, F.lit(value))
    rows = grid.where(F.col("var").isin(*thresholds) & F.col("lead_h").between(*leads) & F.col("value").isNotNull())
    share = rows.groupBy(run, "var", "lead_h").agg(F.avg((F.col("value") > limit).cast("double")).alias("share"))
    return share.groupBy(run, "var").agg(F.max("share").alias("cover"))


def cape_peak(grid: DataFrame, leads: tuple[int, int] = GATE_LEADS, run: str = "init_h") -> DataFrame:
    """Highest instability of a run over all cells and leads."""
    rows = grid.where((F.col("var") == "cape_ml") & F.col("lead_h").between(*leads))
    return rows.groupBy(run).agg(F.max("value").alias("cape_max_jkg"))


def wet_fraction(
    grid: DataFrame, leads: tuple[int, int] = GATE_LEADS, wet_mm: float = 1.0, run: str = "init_h"
) -> DataFrame:
    """Share of cells with more than ``wet_mm`` between lead lo-1 and lead hi.

    One grouping per cell; a missing lower field, and lead 0, count as zero. A
    run without the upper field is absent from the result.
    """
    lower, upper = max(leads[0] - 1, 0), leads[1]
    rows = grid.where((F.col("var") == "tot_prec") & F.col("lead_h").isin(lower, upper))
    at_lower = F.when((F.col("lead_h") == lower) & (F.col("lead_h") > 0), F.col("value"))
    cells = rows.groupBy(run, *CELL).agg(
        F.max(F.when(F.col("lead_h") == upper, F.col("value"))).alias("_hi"), F.max(at_lower).alias("_lo")
    )
    fallen = F.col("_hi") - F.coalesce("_lo", F.lit(0.0))
    return cells.where("_hi IS NOT NULL").groupBy(run).agg(F.avg((fallen > wet_mm).cast("double")).alias("wet_frac"))


def _percent(share: Column) -> Column:
    """Whole percent, halves to even."""
    return F.concat(F.bround(share * 100).cast("long").cast("string"), F.lit("%"))


def gate_decision(
    cover: DataFrame,
    wet: DataFrame,
    thresholds: GateThresholds = GateThresholds(),
    run: str = "init_h",
    peak: DataFrame | None = None,
    leads: tuple[int, int] = GATE_LEADS,
    box: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """Fires when any branch holds: widespread instability, sun, or dry convection.

    ``peak`` (see :func:`cape_peak`), the leads and the box that the shares were
    taken over go into the metrics; they decide nothing.
    """
    g = thresholds

    def of(var: str) -> Column:
        return F.max(F.when(F.col("var") == var, F.col("cover")))

    wide = cover.groupBy(run).agg(
        of("cape_ml").alias("cape_cover_frac"), of("asob_s").alias("rad_cover_frac"), of("htop_dc").alias("htop_dc_cover_frac")
    )
    facts = wide.join(wet, run, "full")
    if peak is None:
        facts = facts.withColumn("cape_max_jkg", F.lit(None).cast("double"))
    else:
        facts = facts.join(peak, run, "left")
    cape, sun, dry, rain = (F.col(c) for c in ("cape_cover_frac", "rad_cover_frac", "htop_dc_cover_frac", "wet_frac"))

    def text(name: str, share: Column, limit: float, cell: float) -> Column:
        tail = f">{round(limit * 100)}%@{cell:.0f}"
        return F.concat(F.lit(name + "="), _percent(share), F.lit(tail))

    blue = F.concat(
        F.lit("blue_day(wet="), _percent(rain), F.lit(f"<{round(g.precip_wet_max_frac * 100)}%,htop_dc_cover="),
        _percent(dry), F.lit(f">{round(g.htop_dc_cover_frac * 100)}%)"),
    )
    reasons = F.concat_ws(
        " OR ",
        F.when(cape > g.cape_cover_frac, text("cape_cover", cape, g.cape_cover_frac, g.cape_cell)),
        F.when(sun > g.rad_cover_frac, text("rad_cover", sun, g.rad_cover_frac, g.rad_cell)),
        F.when((rain < g.precip_wet_max_frac) & (dry > g.htop_dc_cover_frac), blue),
    )
    scope = (F.array(*map(F.lit, leads)).alias("leads"), F.array(*map(F.lit, box or ())).cast("array<double>").alias("bbox"))
    metrics = F.struct(cape, sun, dry, rain, "cape_max_jkg", *scope, F.struct(*[F.lit(v).alias(k) for k, v in asdict(g).items()]).alias("thresholds"))
    return facts.select(
        run,
        (reasons != "").alias("fire"),
        F.when(reasons != "", reasons).otherwise("no_threshold_met").alias("reason"),
        metrics.alias("metrics"),
    )


# -- expected files ----------------------------------------------------------


def file_key(df: DataFrame) -> DataFrame:
    """Adds ``file_name``, ``url`` and the reason a key is invalid (null if valid).

    Needs ``init, lead_h, var, level_type, level``.
    """
    single = F.col("level_type") == "single-level"
    token = F.when(single, F.concat(F.lit("2d_"), F.col("var"))).otherwise(F.concat_ws("_", F.col("level").cast("string"), F.col("var")))
    name = F.concat(
        F.lit(f"{FILE_STEM}_"), F.col("level_type"), F.lit("_"), F.date_format("init", "yyyyMMddHH"), F.lit("_"),
        F.lpad(F.col("lead_h").cast("string"), 3, "0"), F.lit("_"), token, F.lit(".grib2"),
    )
    invalid = (
        F.when(~F.hour("init").isin(*INIT_HOURS), "init hour")
        .when(~F.col("lead_h").between(0, MAX_LEAD), "lead")
        .when(~F.col("level_type").isin("single-level", "model-level", "time-invariant"), "level type")
        .when(single & F.col("level").isNotNull(), "level on a single-level file")
        .when(~single & F.col("level").isNull(), "level missing")
    )
    url = F.concat_ws("/", F.lit(FILE_URL), F.date_format("init", "HH"), F.col("var"), F.concat(F.col("file_name"), F.lit(".bz2")))
    return df.withColumn("invalid", invalid).withColumn("file_name", name).withColumn("url", url)


def expected_files(inits: DataFrame, tier: str, lead_max: int = MAX_LEAD, profile_leads=PROFILE_LEADS, n_levels: int = N_LEVELS) -> DataFrame:
    """Every file of a run: surface fields (``tier1``) or profiles (``tier2``)."""
    no_level = F.lit(None).cast("int").alias("level")
    if tier == "tier1":
        return scaffold(inits.select("init"), (0, lead_max), SURFACE_VARS).select(
            "init", F.lit("tier1").alias("tier"), F.col("init").alias("run"), "lead_h", "var",
            F.lit("single-level").alias("level_type"), no_level,
        )
    if tier != "tier2":
        raise ValueError(f"unknown tier {tier!r}")
    levels = scaffold(inits.select("init"), profile_leads, PROFILE_VARS).select(
        F.col("init").alias("run"), "init", "lead_h", "var", F.lit("model-level").alias("level_type"),
        F.explode(F.sequence(F.lit(1), F.lit(n_levels))).alias("level"),
    )
    half = inits.select(
        F.col("init").alias("run"), F.date_trunc("day", "init").alias("init"), F.lit(0).alias("lead_h"),
        F.lit("hhl").alias("var"), F.lit("time-invariant").alias("level_type"),
        F.explode(F.sequence(F.lit(1), F.lit(n_levels + 1))).alias("level"),
    )
    both = levels.unionByName(half)
    return both.select("init", F.lit("tier2").alias("tier"), "run", "lead_h", "var", "level_type", "level")


def file_completeness(expected: DataFrame, present: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Attempted, ok, missing and failed files and bytes per run and tier.

    ``present`` has one row per attempted key with ``error`` and ``bytes``.
    """
    joined = expected.join(present.withColumn("_seen", F.lit(True)), keys, "left")
    ok = F.col("_seen") & F.col("error").isNull()
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return joined.groupBy(*group).agg(
        F.count("*").alias("files_attempted"),
        count(ok).alias("files_ok"),
        count(F.col("_seen").isNull()).alias("files_missing"),
        count(F.col("error").isNotNull()).alias("files_error"),
        F.sum(F.when(ok, F.col("bytes")).otherwise(0)).alias("bytes_on_disk"),
    )


# -- vertical interpolation --------------------------------------------------


def interp_profile(
    profile: DataFrame, keys: list[str], values: list[str], step_m: int, bottom_m: int, top_m: int, z: str = "height_m"
) -> DataFrame:
    """Linear interpolation onto layers every ``step_m``, clamped at both ends.

    Each interval between two levels emits its own layers, so there is no join.
    Adds ``in_range``, false on clamped layers.
    """
    order = W.partitionBy(*keys).orderBy(z)
    names = [z, *values]
    spans = profile.select(
        *keys, *names,
        *[F.lead(c).over(order).alias(f"_up_{c}") for c in names],
        F.lag(z).over(order).isNull().alias("_lowest"),
    )
    top = F.col(f"_up_{z}")
    first_layer = F.when(F.col("_lowest"), F.lit(bottom_m)).otherwise((F.ceil(F.col(z) / step_m) * step_m).cast("int"))
    last_layer = F.when(top.isNull(), F.lit(top_m)).otherwise((F.ceil(top / step_m) * step_m).cast("int") - step_m)
    spans = spans.withColumn("_from", F.greatest(first_layer, F.lit(bottom_m))).withColumn(
        "_to", F.least(last_layer, F.lit(top_m))
    )
    layers = spans.where("_from <= _to").select("*", F.explode(F.sequence("_from", "_to", F.lit(step_m))).alias("z_m"))
    share = (F.col("z_m") - F.col(z)) / (top - F.col(z))
    inside = F.col("z_m") >= F.col(z)

    def at(c: str) -> Column:
        return F.when(~inside | top.isNull(), F.col(c)).otherwise(F.col(c) + share * (F.col(f"_up_{c}") - F.col(c)))

    in_range = inside & (top.isNotNull() | (F.col("z_m") == F.col(z)))
    return layers.select(*keys, "z_m", *[at(c).alias(c) for c in values], in_range.alias("in_range"))


BLEND_TOP_M = 2300.0


def blend_soundings(stations: DataFrame, aloft: DataFrame, keys: list[str]) -> DataFrame:
    """Station and free-air soundings on one grid, blended by height.

    The free-air weight ramps from 0 to 1 at 2300 m; a source out of range has
    weight 0 and the other takes over. Dewpoint never exceeds temperature.
    Both inputs are :func:`interp_profile` results with ``t_k, td_k``.
    """

    def named(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*keys, "z_m", *[F.col(c).alias(f"{c}_{tag}") for c in ("t_k", "td_k", "in_range")])

    both = named(stations, "st").join(named(aloft, "rs"), [*keys, "z_m"], "full")
    ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("z_m") / BLEND_TOP_M))
    st_ok = F.coalesce("in_range_st", F.lit(False)).cast("double")
    rs_ok = F.coalesce("in_range_rs", F.lit(False)).cast("double")
    weighted = both.withColumn("_rs", ramp * rs_ok).withColumn("_st", (1.0 - ramp) * st_ok)
    # Where both weights vanish the valid source counts in full.
    lost = (F.col("_rs") + F.col("_st")) == 0
    weighted = weighted.withColumn("_w_rs", F.when(lost, rs_ok).otherwise(F.col("_rs"))).withColumn(
        "_w_st", F.when(lost & (rs_ok == 0), st_ok).otherwise(F.col("_st"))
    )
    total = F.col("_w_rs") + F.col("_w_st")

    def mix(c: str) -> Column:
        parts = F.coalesce(F.col(f"{c}_st"), F.lit(0.0)) * F.col("_w_st") + F.coalesce(F.col(f"{c}_rs"), F.lit(0.0)) * F.col("_w_rs")
        return F.when(total > 0, parts / total)

    mixed = weighted.select(*keys, "z_m", mix("t_k").alias("t_k"), mix("td_k").alias("td_k"))
    p = standard_pressure(F.col("z_m"))
    capped = mixed.withColumn("td_k", F.least("td_k", "t_k")).withColumn("p_pa", p)
    return capped.withColumn("theta_k", potential_temperature(F.col("t_k"), F.col("p_pa")))


ANCHOR_HOURS = (0, 3, 6, 9)
PUBLISH_LATENCY_MIN = 150


def due_inits(nows: DataFrame, days: int, anchors: tuple[int, ...] = ANCHOR_HOURS) -> DataFrame:
    """Runs that should be available: per anchor hour the latest, and ``days`` back.

    ``nows`` has one row per evaluation time, column ``now``.
    """
    slots = nows.select("now", F.explode(F.array(*[F.lit(a) for a in anchors])).alias("anchor_h"))
    today = F.date_trunc("day", "now") + F.make_dt_interval(hours=F.col("anchor_h"))
    ready = F.col("now") >= today + F.make_dt_interval(mins=F.lit(PUBLISH_LATENCY_MIN))
    latest = F.when(ready, today).otherwise(today - F.make_dt_interval(days=F.lit(1)))
    back = slots.withColumn("_latest", latest).select("*", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("_back"))
    return back.select("now", "anchor_h", (F.col("_latest") - F.make_dt_interval(days=F.col("_back"))).alias("init"))
