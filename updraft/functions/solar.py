"""Clear-sky surface energy balance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from updraft.functions.air import clip, saturation_vapour_pressure

# Fixed values of the empirical balance.
SOLAR_W_M2 = 1200.0
EXTINCTION = 0.323
EXTINCTION_SCALE_M = 2333.0
ALBEDO = 0.15
STEFAN_BOLTZMANN = 5.67e-8
SKIN_K_M2_W = 0.005
EVAPORATION = 0.60
GROUND = 0.15
SKIN_ROUNDS = 3


def declination_deg(day_of_year: Column) -> Column:
    return 23.44 * F.sin(F.radians(360.0 * (284 + day_of_year) / 365.0))


def sin_elevation(lat: Column, declination: Column, hour_angle: Column) -> Column:
    """Sine of the sun's elevation over flat ground; all arguments in degrees."""
    phi, dec, ha = F.radians(lat), F.radians(declination), F.radians(hour_angle)
    return F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(ha)


def clear_sky_flux_columns(df: DataFrame) -> DataFrame:
    """Adds net radiation, sensible and latent flux and skin temperature.

    Needs ``lat, day_of_year, solar_hour, z_m, t_k, td_k``.
    """
    t = F.col("t_k")
    sun = df.withColumn("_dec", declination_deg(F.col("day_of_year"))).withColumns(
        {
            "sin_elevation": clip(
                sin_elevation(F.col("lat"), F.col("_dec"), 15.0 * (F.col("solar_hour") - 12.0)), 0.0
            ),
            "sin_elevation_max": clip(sin_elevation(F.col("lat"), F.col("_dec"), F.lit(0.0)), 1e-6),
        }
    )
    up = F.col("sin_elevation")
    path = EXTINCTION * F.exp(-F.col("z_m") / EXTINCTION_SCALE_M) * F.col("sin_elevation_max") / up
    shortwave = F.when(up <= 0, F.lit(0.0)).otherwise(SOLAR_W_M2 * up * F.exp(-path) * (1.0 - ALBEDO))
    sky = 0.594 + 0.0416 * F.sqrt(saturation_vapour_pressure(F.col("td_k")))
    out = sun.withColumn("_short", shortwave).withColumn("_sky", sky).withColumn("t_skin_k", t)
    for _ in range(SKIN_ROUNDS):
        longwave = STEFAN_BOLTZMANN * (F.pow("t_skin_k", 4) - F.col("_sky") * F.pow(t, 4))
        out = out.withColumn("net_w_m2", F.col("_short") - longwave)
        out = out.withColumn("t_skin_k", t + SKIN_K_M2_W * F.col("net_w_m2"))
    available = (1.0 - GROUND) * F.col("net_w_m2")
    return (
        out.withColumn("latent_w_m2", EVAPORATION * available)
        .withColumn("sensible_w_m2", (1.0 - EVAPORATION) * available)
        .drop("_dec", "_short", "_sky")
    )
