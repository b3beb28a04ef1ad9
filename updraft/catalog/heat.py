"""Mixed-layer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from updraft import fixtures as fx
from updraft.catalog.registry import query, rounded
from updraft.operators import heat

# The double loop over levels, as the definition has it.
CURVE = """
, lv AS (SELECT region_id, height_m AS z, theta_k AS th, ROW_NUMBER() OVER w - 1 AS k, LAG(height_m) OVER w AS zb, LAG(theta_k) OVER w AS tb FROM profile WINDOW w AS (PARTITION BY region_id ORDER BY height_m))
, curve AS (SELECT a.region_id, CAST(a.k AS INT) AS step, a.z, a.th, COALESCE(1005.0e0 * SUM(CASE WHEN b.k > 0 THEN 0.5e0 * ((a.th - b.tb) + (a.th - b.th)) * (b.z - b.zb) END), 0.0e0) AS g
    FROM lv a JOIN lv b ON a.region_id = b.region_id AND b.k <= a.k GROUP BY 1, 2, 3, 4)"""
HEATED = """
, heated AS (SELECT region_id, init_h, lead_h, flux_w_m2, SUM(GREATEST(flux_w_m2, 0) * 3600.0e0) OVER (PARTITION BY region_id, init_h ORDER BY lead_h) AS h FROM flux)"""
LOOKUP = """
, last_level AS (SELECT region_id, MAX(step) AS n, ARG_MAX(g, step) AS g_top FROM curve GROUP BY 1)
, hit AS (SELECT e.region_id, e.init_h, e.lead_h, MIN(c.step) AS k FROM heated e JOIN curve c ON c.region_id = e.region_id AND c.step > 0 AND c.g >= e.h GROUP BY 1, 2, 3)
, topped AS (SELECT e.*, l.g_top, f.z AS z0,
    CASE WHEN e.h <= 0 THEN f.z WHEN e.h >= l.g_top THEN t.z ELSE lo.z + (e.h - lo.g) / (hi.g - lo.g) * (hi.z - lo.z) END AS z_top,
    CASE WHEN e.h <= 0 THEN f.th WHEN e.h >= l.g_top THEN t.th ELSE lo.th + (e.h - lo.g) / (hi.g - lo.g) * (hi.th - lo.th) END AS th_m
    FROM heated e JOIN last_level l ON l.region_id = e.region_id JOIN curve f ON f.region_id = e.region_id AND f.step = 0 JOIN curve t ON t.region_id = e.region_id AND t.step = l.n
    LEFT JOIN hit q ON q.region_id = e.region_id AND q.init_h = e.init_h AND q.lead_h = e.lead_h
    LEFT JOIN curve hi ON hi.region_id = e.region_id AND hi.step = q.k LEFT JOIN curve lo ON lo.region_id = e.region_id AND lo.step = q.k - 1)
, evolved AS (SELECT *, GREATEST(z_top - z0, 0) AS depth, CASE WHEN flux_w_m2 > 0 AND z_top > z0 THEN POW(9.80665e0 / th_m * (flux_w_m2 / 1005.0e0) * (z_top - z0), 1.0e0 / 3) ELSE 0.0e0 END AS w FROM topped)"""


def evolution(spark, d):
    return heat.mixed_layer_evolution(fx.profile(spark, d), fx.flux(spark, d), ["region_id", "init_h"], ["region_id"])


@query("h1_heat_capacity_curve", fx.with_sql("profile", body=CURVE + "SELECT region_id, step, z AS height_m, ROUND(g, 2) AS heat_j_m2 FROM curve"))
def _h1(spark, d):
    curve = heat.heat_capacity_curve(fx.profile(spark, d), ["region_id"])
    return rounded(curve.select("region_id", "step", "height_m", "heat_j_m2"), heat_j_m2=2)


@query("h2_cumulative_heat", fx.with_sql("grid_cell", "flux", body=HEATED + "SELECT region_id, init_h, lead_h, ROUND(h, 2) AS heat_cum_j_m2 FROM heated"))
def _h2(spark, d):
    out = heat.cumulative_heat(fx.flux(spark, d), ["region_id", "init_h"])
    return rounded(out.select("region_id", "init_h", "lead_h", "heat_cum_j_m2"), heat_cum_j_m2=2)


@query(
    "j14_heat_to_top",
    fx.with_sql("grid_cell", "flux", "profile", body=CURVE + HEATED + LOOKUP + "SELECT region_id, init_h, lead_h, ROUND(z_top, 3) AS z_top_m, ROUND(th_m, 4) AS theta_mixed_k FROM topped"),
)
def _j14(spark, d):
    heated = heat.cumulative_heat(fx.flux(spark, d), ["region_id", "init_h"])
    out = heat.heat_to_top(heat.heat_capacity_curve(fx.profile(spark, d), ["region_id"]), heated, ["region_id"])
    return rounded(out.select("region_id", "init_h", "lead_h", "z_top_m", "theta_mixed_k"), z_top_m=3, theta_mixed_k=4)


@query(
    "h3_mixed_layer_evolution",
    fx.with_sql("grid_cell", "flux", "profile", body=CURVE + HEATED + LOOKUP + """
    SELECT region_id, init_h, lead_h, ROUND(z_top, 3) AS z_top_m, ROUND(th_m, 4) AS theta_mixed_k, ROUND(depth, 3) AS depth_m, ROUND(w, 4) AS w_star_ms FROM evolved"""),
)
def _h3(spark, d):
    cols = ["region_id", "init_h", "lead_h", "z_top_m", "theta_mixed_k", "depth_m", "w_star_ms"]
    return rounded(evolution(spark, d).select(*cols), z_top_m=3, theta_mixed_k=4, depth_m=3, w_star_ms=4)


@query(
    "h4_mixed_layer_top",
    fx.with_sql("profile", body=CURVE + """, f AS (SELECT region_id, MIN(CASE WHEN step = 0 THEN th END) AS t0 FROM curve GROUP BY 1)
    , b AS (SELECT c.region_id, MIN(CASE WHEN th - t0 > 1.1e0 THEN step END) AS broken, MAX(step) AS n FROM curve c JOIN f USING (region_id) GROUP BY 1)
    SELECT region_id, CAST(COALESCE(broken - 1, n) AS INT) AS top_step FROM b"""),
)
def _h4(spark, d):
    return heat.mixed_layer_top(fx.profile(spark, d), ["region_id"], 1.1)


@query(
    "h5_surface_lcl",
    fx.with_sql("sounding", body=""", lo AS (SELECT sample_id % 25 AS region_id, ARG_MIN(sample_id, z_m) AS sid, MIN(z_m) AS z FROM sounding GROUP BY 1)
    , a AS (SELECT l.region_id, z, 101325.0e0 * POW(1 - 0.0065e0 * z / 288.15e0, 9.80665e0 / (287.04e0 * 0.0065e0)) AS p, 295.0e0 + 0.01e0 * (sid % 100) AS theta, 0.004e0 + 0.0001e0 * (sid % 50) AS q FROM lo l)
    , b AS (SELECT *, theta * POW(p / 100000.0e0, 287.04e0 / 1005.0e0) AS t, LN(GREATEST(q * p / 100 / (287.04e0 / 461.5e0 + q), 1e-6) / 6.112e0) AS lg FROM a)
    SELECT region_id, ROUND(z + 125 * GREATEST(t - (243.12e0 * lg / (17.62e0 - lg) + 273.15e0), 0), 3) AS lcl_m FROM b"""),
)
def _h5(spark, d):
    from updraft.functions import air

    key = F.col("sample_id")
    layers = fx.sounding(spark, d).select(
        (key % 25).alias("region_id"), "z_m", (295.0 + 0.01 * (key % 100)).alias("theta_k"),
        (0.004 + 0.0001 * (key % 50)).alias("q"), air.standard_pressure(F.col("z_m")).alias("p_pa"),
    )
    return rounded(heat.surface_lcl(layers, ["region_id"]), lcl_m=3)


@query(
    "h6_run_summary",
    fx.with_sql("grid_cell", "flux", "profile", body=CURVE + HEATED + LOOKUP + """
    SELECT region_id, init_h, ROUND(ARG_MIN(depth, lead_h), 3) AS depth_start_m, ROUND(ARG_MAX(depth, lead_h), 3) AS depth_end_m, ROUND(MAX(depth), 3) AS depth_max_m,
      ARG_MAX(lead_h, (depth, -lead_h)) AS depth_max_at, ROUND(MAX(w), 4) AS w_star_max_ms, ROUND(ARG_MAX(th_m, lead_h) - ARG_MIN(th_m, lead_h), 4) AS theta_gain_k FROM evolved GROUP BY 1, 2"""),
)
def _h6(spark, d):
    out = heat.run_summary(evolution(spark, d), ["region_id", "init_h"])
    return rounded(out, depth_start_m=3, depth_end_m=3, depth_max_m=3, w_star_max_ms=4, theta_gain_k=4)
