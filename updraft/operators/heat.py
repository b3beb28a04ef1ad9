"""Mixed-layer growth from surface heat, for every region and run at once.

A profile is ``(keys..., level, height_m, theta_k)``; its levels are few (65 in
the forecast), so windows per profile stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from updraft.functions import air
from updraft.operators.grids import stop_unless


def heat_capacity_curve(profile: DataFrame, keys: list[str], rho: float = 1.0) -> DataFrame:
    """Heat in J/m2 needed to mix the column up to each level.

    A running trapezoid of potential temperature replaces the double loop over
    levels. Profiles need two levels or more and strictly rising heights.
    """
    up = W.partitionBy(*keys).orderBy("height_m")
    z, theta = F.col("height_m"), F.col("theta_k")
    whole = W.partitionBy(*keys)
    staged = profile.select(
        *keys, "height_m", "theta_k",
        F.first("height_m").over(up).alias("_z0"),
        F.lag("height_m").over(up).alias("_z_below"),
        F.lag("theta_k").over(up).alias("_theta_below"),
        (F.row_number().over(up) - 1).alias("step"),
        F.count(F.lit(1)).over(whole).alias("_n"),
    )
    sound = (F.col("_n") >= 2) & (F.col("_z_below").isNull() | (z > F.col("_z_below")))
    staged = staged.where(stop_unless(sound, "a profile needs two or more strictly rising levels"))
    slab = F.coalesce((theta + F.col("_theta_below")) / 2 * (z - F.col("_z_below")), F.lit(0.0))
    mixed = staged.withColumn("_below", F.sum(slab).over(up.rowsBetween(W.unboundedPreceding, 0)))
    heat = air.C_P * rho * (theta * (z - F.col("_z0")) - F.col("_below"))
    return mixed.withColumn("heat_j_m2", F.when(F.col("step") == 0, F.lit(0.0)).otherwise(heat)).select(
        *keys, "step", "height_m", "theta_k", "heat_j_m2"
    )


def curve_intervals(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Curve rows as lookup intervals ``heat_above < h <= heat_upto``.

    The running maximum makes the intervals disjoint even where the curve dips,
    and selects the first level that needs as much heat as there is. Two open
    intervals stand for no heat (the surface) and too much heat (the top).
    """
    up = W.partitionBy(*keys).orderBy("step")
    ever = up.rowsBetween(W.unboundedPreceding, 0)
    before = up.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    staged = curve.select(
        "*",
        F.max("heat_j_m2").over(ever).alias("_peak"),
        F.max("heat_j_m2").over(before).alias("_peak_before"),
        F.lag("heat_j_m2").over(up).alias("_g_lo"),
        F.lag("height_m").over(up).alias("_z_lo"),
        F.lag("theta_k").over(up).alias("_th_lo"),
        F.max_by("heat_j_m2", "step").over(whole).alias("_g_top"),
        F.max("step").over(whole).alias("_last"),
    )

    def interval(above: Column, upto: Column, g_lo: Column, g_hi: Column, z_lo: Column, z_hi: Column, t_lo: Column, t_hi: Column) -> Column:
        names = ("heat_above", "heat_upto", "g_lo", "g_hi", "z_lo", "z_hi", "theta_lo", "theta_hi")
        return F.struct(*[c.cast("double").alias(n) for n, c in zip(names, (above, upto, g_lo, g_hi, z_lo, z_hi, t_lo, t_hi))])

    z, theta, g = F.col("height_m"), F.col("theta_k"), F.col("heat_j_m2")
    far, unit, none = F.lit(float("inf")), F.lit(1.0), F.lit(0.0)
    inner = F.when(
        (F.col("step") > 0) & (F.col("_peak_before") < F.least("_peak", "_g_top")),
        interval(F.col("_peak_before"), F.least("_peak", "_g_top"), F.col("_g_lo"), g, F.col("_z_lo"), z, F.col("_th_lo"), theta),
    )
    surface = F.when(F.col("step") == 0, interval(-far, none, none, unit, z, z, theta, theta))
    top = F.when(
        F.col("step") == F.col("_last"),
        interval(F.greatest(F.col("_g_top"), none), far, none, unit, z, z, theta, theta),
    )
    parts = F.array_compact(F.array(inner, surface, top))
    return staged.select(*keys, F.explode(parts).alias("_i")).select(*keys, "_i.*")


def heat_to_top(curve: DataFrame, heat: DataFrame, keys: list[str], amount: str = "heat_cum_j_m2") -> DataFrame:
    """Adds mixed-layer top and temperature for each amount of heat.

    Equi-join on the profile keys with the interval as residual: exactly one
    interval holds each amount.
    """
    h = F.col(amount)
    intervals = curve_intervals(curve, keys)
    left, right = heat.alias("h"), intervals.alias("c")
    same = [F.col(f"h.{k}") == F.col(f"c.{k}") for k in keys]
    held = (F.col(f"h.{amount}") > F.col("c.heat_above")) & (F.col(f"h.{amount}") <= F.col("c.heat_upto"))
    condition = held
    for s in same:
        condition = s & condition
    joined = left.join(right, condition, "left").select("h.*", *[f"c.{c}" for c in intervals.columns if c not in keys])
    share = (h - F.col("g_lo")) / (F.col("g_hi") - F.col("g_lo"))
    lerp = lambda a, b: F.when(F.col(a) == F.col(b), F.col(a)).otherwise(F.col(a) + share * (F.col(b) - F.col(a)))
    found = joined.withColumn("z_top_m", lerp("z_lo", "z_hi")).withColumn("theta_mixed_k", lerp("theta_lo", "theta_hi"))
    return found.drop("heat_above", "heat_upto", "g_lo", "g_hi", "z_lo", "z_hi", "theta_lo", "theta_hi")


def cumulative_heat(flux: DataFrame, keys: list[str], dt_s: float = 3600.0, time: str = "lead_h") -> DataFrame:
    """Adds the running sum of upward heat, ``heat_cum_j_m2``.

    A missing flux leaves the sum unknown from there on.
    """
    order = W.partitionBy(*keys).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    gaps = F.sum(F.col("flux_w_m2").isNull().cast("int")).over(order)
    total = F.sum(air.clip(F.col("flux_w_m2"), 0.0) * dt_s).over(order)
    return flux.withColumn("heat_cum_j_m2", F.when(gaps == 0, total))


def mixed_layer_evolution(profile: DataFrame, flux: DataFrame, keys: list[str], profile_keys: list[str], dt_s: float = 3600.0) -> DataFrame:
    """Mixed-layer top, temperature, depth and velocity scale at every step."""
    curve = heat_capacity_curve(profile, profile_keys)
    heated = cumulative_heat(flux, keys, dt_s)
    topped = heat_to_top(curve, heated, profile_keys)
    ground = curve.where("step = 0").select(*profile_keys, F.col("height_m").alias("_z0"))
    placed = topped.join(ground, profile_keys)
    depth = air.clip(F.col("z_top_m") - F.col("_z0"), 0.0)
    with_depth = placed.withColumn("depth_m", depth).drop("_z0")
    w = air.convective_velocity(F.col("flux_w_m2"), F.col("depth_m"), F.col("theta_mixed_k"))
    return with_depth.withColumn("w_star_ms", w)


def mixed_layer_top(profile: DataFrame, keys: list[str], tolerance_k: float = 0.1) -> DataFrame:
    """Highest level of the unbroken block within ``tolerance_k`` of the surface."""
    up = W.partitionBy(*keys).orderBy("height_m")
    staged = profile.withColumn("step", F.row_number().over(up) - 1).withColumn("_theta0", F.first("theta_k").over(up))
    fails = F.col("theta_k") - F.col("_theta0") > tolerance_k
    firsts = staged.groupBy(*keys).agg(F.min(F.when(fails, F.col("step"))).alias("_broken"), F.max("step").alias("_last"))
    return firsts.select(*keys, F.coalesce(F.col("_broken") - 1, F.col("_last")).alias("top_step"))


def surface_lcl(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Lifting condensation level of the lowest layer; needs ``z_m, theta_k, q, p_pa``."""
    low = layers.groupBy(*keys).agg(F.min_by(F.struct("z_m", "theta_k", "q", "p_pa"), "z_m").alias("_low"))
    q, p, z = F.col("_low.q"), F.col("_low.p_pa"), F.col("_low.z_m")
    t = air.temperature_from_theta(F.col("_low.theta_k"), p)
    e_hpa = q * p / 100.0 / (air.EPSILON + q)
    return low.select(*keys, air.lcl_height(t, air.dewpoint_from_vapour_pressure(e_hpa), z).alias("lcl_m"))


def run_summary(series: DataFrame, keys: list[str], time: str = "lead_h") -> DataFrame:
    """Start, end and largest depth with its time, largest w*, warming."""
    last, first = F.max_by("theta_mixed_k", time), F.min_by("theta_mixed_k", time)
    return series.groupBy(*keys).agg(
        F.min_by("depth_m", time).alias("depth_start_m"),
        F.max_by("depth_m", time).alias("depth_end_m"),
        F.max("depth_m").alias("depth_max_m"),
        F.max_by(time, F.struct("depth_m", -F.col(time))).alias("depth_max_at"),
        F.max("w_star_ms").alias("w_star_max_ms"),
        (last - first).alias("theta_gain_k"),
    )
