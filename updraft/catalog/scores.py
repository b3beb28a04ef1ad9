"""Extension queries: bins, spread, day types, events, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from updraft import fixtures as fx
from updraft.catalog.beacons import parsed
from updraft.catalog.heat import CURVE, HEATED, LOOKUP, evolution
from updraft.catalog.registry import query, rounded
from updraft.catalog.spatial import phases_with_region
from updraft.catalog.terrain import AHD, PASSES, RELIEF, passes
from updraft.catalog.tracks import TO_PHASE, stored
from updraft.operators import coverage, scores, spatial

BINNED = """
, bins AS (SELECT region_id, day, t_start_s // 1800 * 1800 AS bin_start_s, COUNT(*) AS n, SUM(n_turns) AS n_circles, MEDIAN(climb_rate_ms) AS med, QUANTILE_CONT(climb_rate_ms, 0.9) AS q90, MAX(alt_top_m) AS top
    FROM phase LEFT JOIN region_box ON lon_centroid >= x0 AND lon_centroid < x1 AND lat_centroid >= y0 AND lat_centroid < y1 GROUP BY 1, 2, 3)"""


@query(
    "e1_thermal_bins",
    fx.with_sql("obs", "region_box", recursive=True, body=TO_PHASE + BINNED + """SELECT region_id, day, CAST(bin_start_s AS BIGINT) AS bin_start_s, n, ROUND(n_circles, 3) AS n_circles, ROUND(med, 3) AS climb_median_ms, ROUND(q90, 3) AS climb_q90_ms,
    ROUND(top, 2) AS top_max_m, n >= 5 AS enough FROM bins"""),
)
def _e1(spark, d):
    out = scores.thermal_bins(stored(phases_with_region(spark, d)))
    return rounded(out, n_circles=3, climb_median_ms=3, climb_q90_ms=3, top_max_m=2)


WIDE = """
, wide AS (SELECT init_h, lead_h, lat_i, lon_i, lat_i % 5 * 5 + lon_i % 5 AS region_id, MAX(CASE WHEN var = 'asob_s' THEN value END) AS flux, MAX(CASE WHEN var = 'cape_ml' THEN value END) AS cape,
    MAX(CASE WHEN var = 'htop_dc' AND value > 2400 THEN value END) AS base_m, MAX(CASE WHEN var = 'tot_prec' AND value > 4 THEN value ELSE 0 END) AS rain_mm FROM grid_cell GROUP BY 1, 2, 3, 4, 5)
, spread AS (SELECT init_h, lead_h, region_id, QUANTILE_CONT(flux, 0.25) AS q25, MEDIAN(flux) AS q50, QUANTILE_CONT(flux, 0.75) AS q75, MEDIAN(base_m) AS base, AVG(CASE WHEN base_m IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END) AS share,
    SQRT(AVG(cape) * AVG(cape) + AVG(rain_mm) * AVG(rain_mm)) AS wind, VAR_POP(cape) + VAR_POP(rain_mm) AS wvar, AVG(CASE WHEN rain_mm > 0 THEN 1.0e0 ELSE 0.0e0 END) AS wet_share FROM wide GROUP BY 1, 2, 3)
, typed AS (SELECT init_h, lead_h, region_id, CASE WHEN wet_share >= 0.5e0 THEN 'thunder' WHEN share >= 0.5e0 THEN 'cumulus' ELSE 'blue' END AS day_type FROM spread)"""


def wide(spark, d):
    def of(var, keep=None):
        hit = F.col("var") == var
        return F.max(F.when(hit & keep if keep is not None else hit, F.col("value")))

    grid = fx.grid_cell(spark, d).withColumn("region_id", F.col("lat_i") % 5 * 5 + F.col("lon_i") % 5)
    rain = F.max(F.when((F.col("var") == "tot_prec") & (F.col("value") > 4), F.col("value")).otherwise(0.0))
    return grid.groupBy("init_h", "lead_h", "lat_i", "lon_i", "region_id").agg(
        of("asob_s").alias("flux"), of("cape_ml").alias("cape"), of("htop_dc", F.col("value") > 2400).alias("base_m"), rain.alias("rain_mm")
    )


SPREAD_KEYS = ["init_h", "lead_h", "region_id"]


@query(
    "e2_regional_spread",
    fx.with_sql("grid_cell", body=WIDE + """SELECT init_h, lead_h, region_id, ROUND(q25, 3) AS cloud_q25, ROUND(q50, 3) AS cloud_median, ROUND(q75, 3) AS cloud_q75, ROUND(base, 3) AS base_median_m,
    ROUND(share, 4) AS base_share, ROUND(wind, 3) AS wind_ms, ROUND(wvar, 2) AS wind_variance FROM spread"""),
)
def _e2(spark, d):
    cells = wide(spark, d).withColumns({"cloud": F.col("flux"), "u": F.col("cape"), "v": F.col("rain_mm")})
    out = scores.regional_spread(cells, SPREAD_KEYS)
    return rounded(out, cloud_q25=3, cloud_median=3, cloud_q75=3, base_median_m=3, base_share=4, wind_ms=3, wind_variance=2)


@query(
    "e2_spread_by_height",
    fx.with_sql("grid_cell", body=WIDE + "SELECT init_h, region_id, CAST(FLOOR(lat_i * 130 / 500.0e0) * 500 AS BIGINT) AS height_class_m, ROUND(AVG(flux), 3) AS mean, COUNT(flux) AS n FROM wide GROUP BY 1, 2, 3"),
)
def _e2_height(spark, d):
    cells = wide(spark, d).withColumn("elev_m", F.col("lat_i") * 130)
    return rounded(scores.spread_by_height(cells, ["init_h", "region_id"], "flux"), mean=3)


def typed_days(spark, d):
    share = lambda c: F.avg(c.cast("double"))
    features = wide(spark, d).groupBy(*SPREAD_KEYS).agg(
        share(F.col("base_m").isNotNull()).alias("base_share"), share(F.col("rain_mm") > 0).alias("wet_share")
    )
    return scores.day_type(features, 0.5, 0.5)


@query("e3_day_type", fx.with_sql("grid_cell", body=WIDE + "SELECT * FROM typed"))
def _e3(spark, d):
    return typed_days(spark, d).select(*SPREAD_KEYS, "day_type")


@query(
    "e4_substep_events",
    fx.with_sql("grid_cell", body=WIDE + """
    , a AS (SELECT *, flux >= 0.9e0 * MAX(flux) OVER (PARTITION BY init_h, lat_i, lon_i) AS near, ABS(cape - LAG(cape) OVER w) > 500 AS jump FROM wide WINDOW w AS (PARTITION BY init_h, lat_i, lon_i ORDER BY lead_h))
    , b AS (SELECT *, SUM(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY init_h, lat_i, lon_i ORDER BY lead_h) AS gap FROM a)
    , c AS (SELECT *, COUNT(CASE WHEN near THEN 1 END) OVER (PARTITION BY init_h, lat_i, lon_i, gap) AS held FROM b)
    , e AS (SELECT init_h, lat_i, lon_i, MIN(CASE WHEN base_m IS NOT NULL THEN lead_h END) AS onset_slice, SUM(CASE WHEN rain_mm > 0 THEN 1 ELSE 0 END) AS wet,
        BOOL_OR(COALESCE(near AND held >= 3, FALSE)) AS sustained_peak, BOOL_OR(COALESCE(jump, FALSE)) AS jump FROM c GROUP BY 1, 2, 3)
    SELECT init_h, lat_i, lon_i, onset_slice, CASE WHEN wet > 6 THEN 'lasting' WHEN wet > 0 AND wet <= 2 THEN 'short' WHEN wet > 0 THEN 'medium' ELSE 'none' END AS rain, sustained_peak, jump FROM e"""),
)
def _e4(spark, d):
    slices = wide(spark, d).withColumnRenamed("lead_h", "slice")
    return scores.substep_events(slices, ["init_h", "lat_i", "lon_i"])


@query(
    "e5_scores",
    fx.with_sql("grid_cell", body="""SELECT a.var, COUNT(*) AS n, ROUND(AVG(b.value - a.value), 3) AS bias, ROUND(SQRT(AVG(POW(b.value - a.value, 2))), 3) AS rmse
    FROM grid_cell a JOIN grid_cell b ON a.var = b.var AND a.lat_i = b.lat_i AND a.lon_i = b.lon_i AND a.init_h + a.lead_h = b.init_h + b.lead_h WHERE a.init_h = 0 AND b.init_h = 3 GROUP BY 1"""),
)
def _e5(spark, d):
    grid = fx.grid_cell(spark, d).withColumn("valid_h", F.col("init_h") + F.col("lead_h"))
    keys = ["var", "lat_i", "lon_i", "valid_h"]
    out = scores.scores(grid.where("init_h = 0"), grid.where("init_h = 3"), keys, ["var"], "value")
    return rounded(out, bias=3, rmse=3)


@query(
    "e5_observed_skill",
    fx.with_sql("obs", "region_box", "grid_cell", "flux", "profile", recursive=True, body=TO_PHASE + BINNED + CURVE + HEATED + LOOKUP + """
    , pairs AS (SELECT b.region_id, CAST(b.bin_start_s % 86400 // 3600 AS BIGINT) AS valid_h,
        CASE WHEN flux_w_m2 > 0 AND z_top > z0 THEN POW(9.80665e0 / th_m * (flux_w_m2 / 1005.0e0) * (z_top - z0), 1.0e0 / 3) ELSE 0.0e0 END - med AS climb, z_top - top AS high
      FROM bins b JOIN topped t ON t.region_id = b.region_id AND t.init_h + t.lead_h = b.bin_start_s % 86400 // 3600)
    SELECT region_id, CAST(valid_h AS DOUBLE) AS valid_h, COUNT(*) AS n, COUNT(*) >= 5 AS enough, ROUND(AVG(climb), 3) AS climb_bias_ms, ROUND(SQRT(AVG(climb * climb)), 3) AS climb_rmse_ms,
      ROUND(AVG(high), 2) AS top_bias_m, ROUND(SQRT(AVG(high * high)), 2) AS top_rmse_m FROM pairs GROUP BY 1, 2"""),
)
def _e5_observed(spark, d):
    """Half hours of observed circling against the mixed layer of the same region and hour."""
    out = scores.observed_skill(scores.thermal_bins(stored(phases_with_region(spark, d))), evolution(spark, d))
    return rounded(out, climb_bias_ms=3, climb_rmse_ms=3, top_bias_m=2, top_rmse_m=2)


@query(
    "e5_class_accuracy",
    fx.with_sql("grid_cell", body=WIDE + """SELECT COUNT(*) AS n, ROUND(AVG(CASE WHEN a.day_type = b.day_type THEN 1.0e0 ELSE 0.0e0 END), 4) AS accuracy
    FROM typed a JOIN typed b ON a.region_id = b.region_id AND a.lead_h = b.lead_h WHERE a.init_h = 0 AND b.init_h = 3"""),
)
def _e5_class(spark, d):
    days = typed_days(spark, d)
    return rounded(scores.class_accuracy(days.where("init_h = 0"), days.where("init_h = 3"), ["region_id", "lead_h"], "day_type"), accuracy=4)


@query(
    "e6_permeability",
    fx.with_sql("pixel", "located_pixel", "grid_cell", "flux", "profile", "region_box", body=AHD + RELIEF + PASSES + CURVE + HEATED + LOOKUP + """
    SELECT region_a, region_b, p.init_h, p.lead_h, ROUND(LEAST(1, GREATEST(0, (LEAST(p.z_top, q.z_top) - rel) / 500)), 4) AS permeability
    FROM passes JOIN topped p ON p.region_id = region_a JOIN topped q ON q.region_id = region_b AND q.init_h = p.init_h AND q.lead_h = p.lead_h"""),
)
def _e6(spark, d):
    """Mixed-layer tops over the heights of the passes between neighbours."""
    tops = evolution(spark, d).select("region_id", "init_h", "lead_h", "z_top_m")
    return rounded(scores.permeability(passes(spark, d), tops), permeability=4)


@query(
    "e7_message_rate",
    fx.with_sql("beacon", "region_box", body="""SELECT region_id, CAST(FLOOR(EPOCH(ts_recv) / 3600) * 3600 AS BIGINT) AS window_start_s, COUNT(*) AS packets, COUNT(DISTINCT source_id) AS n_senders
    FROM beacon LEFT JOIN region_box ON lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1 WHERE lat IS NOT NULL GROUP BY 1, 2"""),
)
def _e7(spark, d):
    located = parsed(spark, d).where("lat IS NOT NULL")
    placed = spatial.points_in_regions(located, fx.region(spark, d), outside=True)
    return scores.message_rate(placed)


@query(
    "e7_receiver_coverage",
    fx.with_sql("beacon", body="""
    , ev AS (SELECT CASE kind WHEN 'receiver' THEN source_id ELSE station END AS receiver, CAST(FLOOR(EPOCH(ts_recv) / 86400) AS BIGINT) AS slot, ts_recv, kind = 'receiver' AS own, lat, lon
      FROM beacon WHERE kind IN ('receiver', 'position'))
    , own AS (SELECT receiver, ts_recv, lat, lon, ROW_NUMBER() OVER (PARTITION BY receiver, ts_recv ORDER BY lat DESC, lon DESC) AS k FROM ev WHERE own)
    , placed AS (SELECT e.receiver, e.slot, e.lat AS la, e.lon AS lo, o.lat AS ra, o.lon AS ro FROM (SELECT * FROM ev WHERE NOT own) e
      ASOF LEFT JOIN (SELECT * FROM own WHERE k = 1) o ON o.receiver = e.receiver AND e.ts_recv >= o.ts_recv)
    , far AS (SELECT receiver, slot, 2 * 6371.0e0 * ASIN(LEAST(1, SQRT(POW(SIN(RADIANS(la - ra) / 2), 2) + COS(RADIANS(ra)) * COS(RADIANS(la)) * POW(SIN(RADIANS(lo - ro) / 2), 2)))) AS km,
        DEGREES(ATAN2(SIN(RADIANS(lo - ro)) * COS(RADIANS(la)), COS(RADIANS(ra)) * SIN(RADIANS(la)) - SIN(RADIANS(ra)) * COS(RADIANS(la)) * COS(RADIANS(lo - ro)))) AS deg FROM placed)
    , per AS (SELECT receiver, slot, CAST(FLOOR(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END / 45) AS INT) AS sector, COUNT(*) AS packets, MAX(km) AS km FROM far GROUP BY 1, 2, 3)
    , whole AS (SELECT a.receiver, a.slot, s.sector, COALESCE(packets, 0) AS packets, COALESCE(km, 0) AS km FROM (SELECT DISTINCT receiver, slot FROM ev) a
        CROSS JOIN (SELECT CAST(UNNEST(RANGE(8)) AS INT) AS sector) s LEFT JOIN per p ON p.receiver = a.receiver AND p.slot = a.slot AND p.sector = s.sector
      UNION ALL SELECT receiver, slot, sector, packets, km FROM per WHERE sector IS NULL)
    SELECT receiver, slot * 86400 AS window_start_s, sector, packets, CASE WHEN sector IS NOT NULL THEN ROUND(km, 3) END AS range_km FROM whole"""),
)
def _e7_coverage(spark, d):
    """How far each receiver heard in each direction, day by day."""
    return rounded(coverage.receiver_coverage(parsed(spark, d), window_s=86_400), range_km=3)


@query(
    "e8_rank_regions",
    fx.with_sql("grid_cell", body=WIDE + """, s AS (SELECT region_id, STDDEV(base_m) AS sd, COUNT(base_m) AS n FROM wide GROUP BY 1)
    SELECT region_id, ROUND(sd, 3) AS spread, n, CAST(RANK() OVER (ORDER BY sd DESC NULLS LAST) AS INT) AS rank FROM s"""),
)
def _e8(spark, d):
    return rounded(scores.rank_regions(wide(spark, d), "base_m"), spread=3)


@query(
    "e8_usable_sample",
    """SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)
    AND CAST(o_orderdate AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders GROUP BY 1 HAVING COUNT(*) >= 7)""",
)
def _e8_sample(spark, d):
    orders = fx.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    quality = orders.groupBy("day").agg((F.count("*") >= 7).alias("good"))
    flights = fx.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return scores.usable_sample(orders.distinct(), flights, quality)
