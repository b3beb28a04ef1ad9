"""Moist-air and surface-flux formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Physical constants in SI units.
G = 9.80665
R_DRY = 287.04
R_VAPOUR = 461.5
C_P = 1005.0
L_V = 2.5e6
EPSILON = R_DRY / R_VAPOUR
P_REF = 100000.0
KAPPA = R_DRY / C_P
T_ZERO_C = 273.15
ISA_T0 = 288.15
ISA_LAPSE = 0.0065
ISA_P0 = 101325.0
LCL_M_PER_K = 125.0

# Two-regime parcel warming, wind reduction, mixing coefficients.
REGIME_FLUX_W_M2 = 75.0
REGIME_DELTA_T_K = 0.5
WIND_REDUCTION = 1.65e-4
MIX_ACCELERATING = 0.0025
MIX_DECELERATING = 0.008


def clip(value: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Value limited to [lo, hi]; null stays null, unlike with greatest/least."""
    out = F.when(value < lo, F.lit(lo)).otherwise(value) if lo is not None else value
    return F.when(out > hi, F.lit(hi)).otherwise(out) if hi is not None else out


def standard_pressure(z: Column) -> Column:
    """Standard-atmosphere pressure in Pa at height ``z`` in m."""
    return ISA_P0 * F.pow(1.0 - ISA_LAPSE * z / ISA_T0, F.lit(G / (R_DRY * ISA_LAPSE)))


def potential_temperature(t: Column, p: Column) -> Column:
    return t * F.pow(P_REF / p, F.lit(KAPPA))


def temperature_from_theta(theta: Column, p: Column) -> Column:
    return theta * F.pow(p / P_REF, F.lit(KAPPA))


def convective_velocity(flux: Column, depth: Column, theta: Column, rho: float = 1.0) -> Column:
    """Convective velocity scale; zero without upward flux or depth."""
    kinematic = flux / (rho * C_P)
    active = (flux > 0) & (depth > 0)
    return F.when(active, F.pow(G / theta * kinematic * depth, F.lit(1.0 / 3.0))).when(
        flux.isNotNull() & depth.isNotNull(), F.lit(0.0)
    )


def saturation_vapour_pressure(t: Column) -> Column:
    """Saturation vapour pressure over water in hPa (Magnus)."""
    c = t - T_ZERO_C
    return 6.112 * F.exp(17.62 * c / (243.12 + c))


def dewpoint_from_vapour_pressure(e_hpa: Column) -> Column:
    log = F.log(clip(e_hpa, 1e-6) / 6.112)
    return 243.12 * log / (17.62 - log) + T_ZERO_C


def mixing_ratio(e_hpa: Column, p: Column) -> Column:
    e = e_hpa * 100.0
    return EPSILON * e / (p - e)


def saturation_mixing_ratio(t: Column, p: Column) -> Column:
    return mixing_ratio(saturation_vapour_pressure(t), p)


def relative_humidity(t: Column, td: Column) -> Column:
    return saturation_vapour_pressure(td) / saturation_vapour_pressure(t)


def lcl_height(t: Column, td: Column, z: Column) -> Column:
    """Lifting condensation level from the dewpoint depression, never below ``z``."""
    depression = t - td
    return z + LCL_M_PER_K * clip(depression, 0.0)


def virtual_temperature(t: Column, r: Column) -> Column:
    return t * (1.0 + r / EPSILON) / (1.0 + r)


def density_temperature(t: Column, r_vapour: Column, r_liquid: Column) -> Column:
    """Virtual temperature with the weight of condensate."""
    return t * (1.0 + r_vapour / EPSILON) / (1.0 + r_vapour + r_liquid)


def air_density(t: Column, p: Column, r_vapour: Column, r_liquid: Column) -> Column:
    return p / (R_DRY * density_temperature(t, r_vapour, r_liquid))


def moist_lapse_rate(t: Column, p: Column) -> Column:
    """Saturated adiabatic lapse rate in K/m."""
    r = saturation_mixing_ratio(t, p)
    return G * (1.0 + L_V * r / (R_DRY * t)) / (C_P + L_V * L_V * r * EPSILON / (R_DRY * t * t))


def qv_to_dewpoint(qv: Column, p: Column, t: Column) -> Column:
    """Dewpoint from specific humidity; 5 K below ``t`` where humidity is missing."""
    r = qv / clip(1.0 - qv, 1e-9)
    e_hpa = r * p / 100.0 / (EPSILON + r)
    return F.when(qv.isNull(), t - 5.0).otherwise(dewpoint_from_vapour_pressure(e_hpa))


def moist_air_columns(soundings: DataFrame) -> DataFrame:
    """Adds the derived air columns to rows of ``z_m, t_k, td_k, r_liquid``."""
    t, td, z, liquid = (F.col(c) for c in ("t_k", "td_k", "z_m", "r_liquid"))
    staged = soundings.withColumns({"p_pa": standard_pressure(z), "e_hpa": saturation_vapour_pressure(td)})
    p = F.col("p_pa")
    with_r = staged.withColumns(
        {
            "theta_k": potential_temperature(t, p),
            "r_vapour": mixing_ratio(F.col("e_hpa"), p),
            "r_saturated": saturation_mixing_ratio(t, p),
            "relative_humidity": relative_humidity(t, td),
            "lcl_m": lcl_height(t, td, z),
            "lapse_k_m": moist_lapse_rate(t, p),
        }
    )
    r = F.col("r_vapour")
    return with_r.withColumns(
        {
            "t_back_k": temperature_from_theta(F.col("theta_k"), p),
            "td_back_k": dewpoint_from_vapour_pressure(F.col("e_hpa")),
            "t_virtual_k": virtual_temperature(t, r),
            "t_density_k": density_temperature(t, r, liquid),
            "density_kg_m3": air_density(t, p, r, liquid),
        }
    )


def flux_regime_columns(df: DataFrame) -> DataFrame:
    """Adds parcel warming, mass, wind factor and mixing coefficient.

    Needs ``flux_w_m2, heat_j, wind_kmh, accelerating``.
    """
    flux = F.col("flux_w_m2")
    warming = (
        F.when(flux <= 0, F.lit(0.0))
        .when(flux >= REGIME_FLUX_W_M2, F.lit(REGIME_DELTA_T_K))
        .otherwise(REGIME_DELTA_T_K * flux / REGIME_FLUX_W_M2)
    )
    mass = F.when((F.col("delta_t_k") <= 0) | (F.col("heat_j") <= 0), F.lit(0.0)).otherwise(
        F.col("heat_j") / (C_P * F.col("delta_t_k"))
    )
    kinetic = 1.0 - WIND_REDUCTION * F.col("wind_kmh") * F.col("wind_kmh")
    return (
        df.withColumn("delta_t_k", warming)
        .withColumn("parcel_mass_kg", mass)
        .withColumn("wind_factor", clip(kinetic, 0.0, 1.0))
        .withColumn("mixing_per_m", F.when(F.col("accelerating"), MIX_ACCELERATING).otherwise(MIX_DECELERATING))
    )
