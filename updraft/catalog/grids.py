"""Grid, gate, file-key and sounding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from updraft import fixtures as fx
from updraft.catalog.registry import query, rnd, rounded
from updraft.catalog.spatial import REP
from updraft.functions import air, solar
from updraft.operators import filters, grids

CENTRE = REP + """
, cells AS (SELECT DISTINCT lat_i, lon_i, lat, lon FROM grid_cell)
, lat_pick AS (SELECT region_id, ARG_MIN(lat_i, (ABS(c.lat - r.lat), c.lat)) AS lat_i FROM rep r, (SELECT DISTINCT lat, lat_i FROM cells) c GROUP BY 1)
, lon_pick AS (SELECT region_id, ARG_MIN(lon_i, (ABS(c.lon - r.lon), c.lon)) AS lon_i FROM rep r, (SELECT DISTINCT lon, lon_i FROM cells) c GROUP BY 1)
, centre AS (SELECT a.region_id, a.lat_i, b.lon_i FROM lat_pick a JOIN lon_pick b ON a.region_id = b.region_id)"""
MAP = """
, cell_map AS (SELECT region_id, lat_i, lon_i FROM cells JOIN region_box ON lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1)
, means AS (SELECT region_id, init_h, lead_h, var, AVG(value) AS mean FROM grid_cell JOIN cell_map USING (lat_i, lon_i) GROUP BY 1, 2, 3, 4)"""
VARS = ("asob_s", "cape_ml", "htop_dc", "tot_prec")


def cells(spark, d):
    return fx.grid_cell(spark, d).select("lat_i", "lon_i", "lat", "lon").distinct()


@query(
    "g1_region_mean",
    fx.with_sql("grid_cell", "region_box", body=CENTRE + MAP + "SELECT region_id, init_h, lead_h, var, ROUND(mean, 4) AS mean FROM means"),
)
def _g1(spark, d):
    cell_map = grids.region_cell_map(cells(spark, d), fx.region(spark, d), require_all=False)
    return rounded(grids.region_mean(fx.grid_cell(spark, d), cell_map, ["init_h", "lead_h", "var"]), mean=4)


@query("g2_nearest_cell", fx.with_sql("grid_cell", "region_box", body=CENTRE + "SELECT region_id, lat_i, lon_i FROM centre"))
def _g2(spark, d):
    from updraft.operators.spatial import representative_points

    return grids.nearest_cell(cells(spark, d), representative_points(fx.region(spark, d)))


#: A turned grid: neither coordinate is constant along a row or a column.
TURN = (0.8, 0.6)


@query(
    "g2_nearest_grid_point",
    fx.with_sql("grid_cell", "region_box", body=REP + """
    , turned AS (SELECT DISTINCT lat_i, lon_i, 46 + 0.8e0 * (lat - 46) - 0.6e0 * (lon - 11) AS lat, 11 + 0.6e0 * (lat - 46) + 0.8e0 * (lon - 11) AS lon FROM grid_cell)
    SELECT region_id, ARG_MIN(lat_i, (ROUND(d, 9), t_lat, t_lon)) AS lat_i, ARG_MIN(lon_i, (ROUND(d, 9), t_lat, t_lon)) AS lon_i
    FROM (SELECT region_id, lat_i, lon_i, t.lat AS t_lat, t.lon AS t_lon, POW(t.lat - r.lat, 2) + POW(t.lon - r.lon, 2) AS d FROM rep r, turned t) GROUP BY 1"""),
)
def _g2_turned(spark, d):
    from updraft.operators.spatial import representative_points

    lat, lon = F.col("lat") - 46, F.col("lon") - 11
    turned = cells(spark, d).withColumns({"lat": 46 + TURN[0] * lat - TURN[1] * lon, "lon": 11 + TURN[1] * lat + TURN[0] * lon})
    return grids.nearest_grid_point(turned, representative_points(fx.region(spark, d)))


SERIES = CENTRE + MAP + """
, full_set AS (SELECT region_id, init_h, CAST(lead_h AS INT) AS lead_h, var FROM (SELECT DISTINCT region_id, init_h FROM grid_cell JOIN cell_map USING (lat_i, lon_i)), range(0, 8) l(lead_h), (VALUES ('asob_s'), ('cape_ml'), ('htop_dc'), ('tot_prec')) v(var))
, pts AS (SELECT region_id, init_h, lead_h, var, value AS centroid FROM grid_cell JOIN centre USING (lat_i, lon_i))
, series AS (SELECT f.*, centroid, mean FROM full_set f LEFT JOIN pts USING (region_id, init_h, lead_h, var) LEFT JOIN means USING (region_id, init_h, lead_h, var))"""


def series(spark, d):
    return grids.surface_series(fx.grid_cell(spark, d), fx.region(spark, d), (0, 7), VARS, require_all=False)


@query(
    "g3_surface_series",
    fx.with_sql("grid_cell", "region_box", body=SERIES + "SELECT region_id, init_h, lead_h, var, ROUND(centroid, 4) AS centroid, ROUND(mean, 4) AS mean FROM series"),
)
def _g3(spark, d):
    return rounded(series(spark, d).select("region_id", "init_h", "lead_h", "var", "centroid", "mean"), centroid=4, mean=4)


@query(
    "g3_surface_series_wide",
    fx.with_sql("grid_cell", "region_box", body=SERIES + """SELECT region_id, init_h, lead_h,
    ROUND(MAX(CASE WHEN var = 'asob_s' THEN centroid END), 4) AS asob_s_centroid, ROUND(MAX(CASE WHEN var = 'asob_s' THEN mean END), 4) AS asob_s_mean,
    ROUND(MAX(CASE WHEN var = 'cape_ml' THEN centroid END), 4) AS cape_ml_centroid, ROUND(MAX(CASE WHEN var = 'cape_ml' THEN mean END), 4) AS cape_ml_mean
    FROM series GROUP BY 1, 2, 3"""),
)
def _g3_wide(spark, d):
    wide = grids.wide_series(series(spark, d), ("asob_s", "cape_ml"), ["region_id", "init_h", "lead_h"])
    return rounded(wide, asob_s_centroid=4, asob_s_mean=4, cape_ml_centroid=4, cape_ml_mean=4)


HEIGHTS = """
, heights AS (SELECT * FROM (SELECT region_id, level, (height_m + LEAD(height_m) OVER (PARTITION BY region_id ORDER BY level)) / 2 AS height_m FROM profile) WHERE height_m IS NOT NULL)"""


def heights(spark, d):
    return grids.profile_heights(fx.profile(spark, d), ["region_id"])


@query("g4_profile_heights", fx.with_sql("profile", body=HEIGHTS + "SELECT region_id, level, ROUND(height_m, 3) AS height_m FROM heights"))
def _g4(spark, d):
    return rounded(heights(spark, d), height_m=3)


def model_levels(spark, d):
    return (
        fx.table(spark, d, "lineitem")
        .select(
            ((F.col("l_orderkey") % 3) * 3).cast("int").alias("init_h"),
            F.when(F.col("l_suppkey") % 2 == 0, "t").otherwise("qv").alias("var"),
            (F.col("l_orderkey") % 12).cast("int").alias("level"),
            F.floor((F.col("l_partkey") % 400) / F.lit(20.0)).cast("int").alias("lat_i"),
            (F.col("l_partkey") % 20).cast("int").alias("lon_i"),
            F.when(F.col("l_suppkey") % 2 == 0, 250.0 + F.col("l_quantity")).otherwise(F.col("l_discount") / 10).alias("value"),
        )
        .groupBy("init_h", "var", "level", "lat_i", "lon_i")
        .agg(F.avg("value").alias("value"))
    )


@query(
    "g5_build_profile",
    fx.with_sql("grid_cell", "region_box", "profile", body=CENTRE + HEIGHTS + """
    , lev AS (SELECT CAST(l_orderkey % 3 AS INT) * 3 AS init_h, CASE WHEN l_suppkey % 2 = 0 THEN 't' ELSE 'qv' END AS var, CAST(l_orderkey % 12 AS INT) AS level,
        CAST(FLOOR((l_partkey % 400) / 20.0e0) AS INT) AS lat_i, CAST(l_partkey % 20 AS INT) AS lon_i,
        AVG(CASE WHEN l_suppkey % 2 = 0 THEN 250.0e0 + l_quantity ELSE l_discount / 10 END) AS value FROM lineitem GROUP BY 1, 2, 3, 4, 5)
    , wide AS (SELECT region_id, init_h, level, MAX(CASE WHEN var = 't' THEN value END) AS t, MAX(CASE WHEN var = 'qv' THEN value END) AS qv
        FROM lev JOIN centre USING (lat_i, lon_i) GROUP BY 1, 2, 3)
    SELECT region_id, init_h, level, CAST(ROW_NUMBER() OVER (PARTITION BY region_id, init_h ORDER BY height_m) - 1 AS INT) AS step, ROUND(height_m, 3) AS height_m,
        ROUND(t, 4) AS t, ROUND(qv, 6) AS qv, ROUND(t * POW(100000.0e0 / (101325.0e0 * POW(1 - 0.0065e0 * height_m / 288.15e0, 9.80665e0 / (287.04e0 * 0.0065e0))), 287.04e0 / 1005.0e0), 4) AS theta_k
    FROM wide JOIN heights USING (region_id, level)"""),
)
def _g5(spark, d):
    from updraft.operators.spatial import representative_points

    centre = grids.nearest_cell(cells(spark, d), representative_points(fx.region(spark, d)))
    out = grids.build_profile(model_levels(spark, d), centre, heights(spark, d), ["init_h"])
    cols = ["region_id", "init_h", "level", "step", "height_m", "t", "qv", "theta_k"]
    return rounded(out.select(*cols), height_m=3, t=4, qv=6, theta_k=4)


DEAVERAGED = """
, dense AS (SELECT region_id, init_h, lead_h, var, CASE WHEN (region_id + lead_h) % 9 = 0 THEN NULL ELSE mean END AS mean FROM series WHERE lead_h <= 6)
, interval_flux AS (SELECT *, CASE WHEN lead_h = 0 THEN 0.0e0 ELSE (mean * lead_h * 3600.0e0 - CASE WHEN lead_h = 1 THEN 0.0e0 ELSE LAG(mean) OVER w * (lead_h - 1) * 3600.0e0 END) / 3600.0e0 END AS flux
    FROM dense WINDOW w AS (PARTITION BY region_id, init_h, var ORDER BY lead_h))"""


def deaveraged(spark, d):
    gappy = F.when((F.col("region_id") + F.col("lead_h")) % 9 == 0, F.lit(None)).otherwise(F.col("mean"))
    dense = series(spark, d).where("lead_h <= 6").withColumn("mean", gappy)
    dense = dense.withColumn("lead_s", F.col("lead_h") * 3600.0)
    return grids.deaverage(dense, ["region_id", "init_h", "var"])


@query(
    "g6_deaverage",
    fx.with_sql("grid_cell", "region_box", body=SERIES + DEAVERAGED + "SELECT region_id, init_h, var, lead_h, ROUND(flux, 3) AS flux FROM interval_flux"),
)
def _g6(spark, d):
    return rounded(deaveraged(spark, d).select("region_id", "init_h", "var", "lead_h", "flux"), flux=3)


@query(
    "g7_to_model_flux",
    fx.with_sql("grid_cell", "region_box", body=SERIES + DEAVERAGED + """
    , wide AS (SELECT region_id, init_h, lead_h, MAX(CASE WHEN var = 'asob_s' THEN flux END) AS a, MAX(CASE WHEN var = 'cape_ml' THEN flux END) AS s, MAX(CASE WHEN var = 'htop_dc' THEN flux END) AS l FROM interval_flux GROUP BY 1, 2, 3)
    SELECT region_id, init_h, lead_h, 'turbulent' AS source, ROUND(-s, 3) AS sensible_w_m2, ROUND(COALESCE(-l, 0), 3) AS latent_w_m2 FROM wide
    UNION ALL SELECT region_id, init_h, lead_h, 'radiation', ROUND(a * 0.3e0, 3), 0.0e0 FROM wide"""),
)
def _g7(spark, d):
    def of(var):
        return F.max(F.when(F.col("var") == var, F.col("flux")))

    wide = deaveraged(spark, d).groupBy("region_id", "init_h", "lead_h").agg(
        of("asob_s").alias("asob_s"), of("cape_ml").alias("ashfl_s"), of("htop_dc").alias("alhfl_s")
    )
    both = [
        grids.to_model_flux(wide, s).select("region_id", "init_h", "lead_h", F.lit(s).alias("source"), "sensible_w_m2", "latent_w_m2")
        for s in ("turbulent", "radiation")
    ]
    return rounded(both[0].unionByName(both[1]), sensible_w_m2=3, latent_w_m2=3)


@query(
    "g8_stack_fields",
    fx.with_sql("grid_cell", body="""
    , base AS (SELECT DISTINCT init_h, lat_i, lon_i FROM grid_cell)
    SELECT b.init_h, CAST(l.lead_h AS INT) AS lead_h, v.var, b.lat_i, b.lon_i, ROUND(g.value, 4) AS value FROM base b, range(0, 7) l(lead_h), (VALUES ('asob_s'), ('cape_ml'), ('htop_dc'), ('tot_prec')) v(var)
    LEFT JOIN grid_cell g ON g.init_h = b.init_h AND g.lead_h = l.lead_h AND g.var = v.var AND g.lat_i = b.lat_i AND g.lon_i = b.lon_i"""),
)
def _g8(spark, d):
    out = grids.stack_fields(fx.grid_cell(spark, d), (0, 6), VARS)
    return rounded(out.select("init_h", "lead_h", "var", "lat_i", "lon_i", "value"), value=4)


def _dedup_sql(direction: str) -> str:
    return fx.with_sql("grid_cell", body=f"""SELECT var, lat_i, lon_i, valid_h, init_h, lead_h, ROUND(value, 4) AS value FROM (
    SELECT *, init_h + lead_h AS valid_h, ROW_NUMBER() OVER (PARTITION BY var, lat_i, lon_i, init_h + lead_h ORDER BY init_h {direction}) AS rn FROM grid_cell) WHERE rn = 1""")  # fmt: skip


@query("g9_dedup_first", _dedup_sql("ASC"))
def _g9(spark, d):
    return rounded(grids.dedup_valid_time(fx.grid_cell(spark, d), "first"), value=4)


@query("g9_dedup_latest_init", _dedup_sql("DESC"))
def _g9_latest(spark, d):
    return rounded(grids.dedup_valid_time(fx.grid_cell(spark, d), "latest_init"), value=4)


@query(
    "g10_spatial_max_series",
    fx.with_sql("grid_cell", body="""
    , first_run AS (SELECT *, init_h + lead_h AS valid_h, ROW_NUMBER() OVER (PARTITION BY var, lat_i, lon_i, init_h + lead_h ORDER BY init_h) AS rn FROM grid_cell)
    SELECT var, valid_h, ROUND(MAX(value), 4) AS value FROM first_run WHERE rn = 1 AND var IN ('cape_ml', 'asob_s', 'tot_prec') AND valid_h >= (SELECT MAX(valid_h) FROM first_run) - 5 GROUP BY 1, 2"""),
)
def _g10(spark, d):
    kept = grids.dedup_valid_time(fx.grid_cell(spark, d))
    return rounded(grids.spatial_max_series(kept, ("cape_ml", "asob_s", "tot_prec"), 5), value=4)


GATE = grids.GateThresholds(
    cape_cell=400.0, cape_cover_frac=0.50, rad_cell=900.0, rad_cover_frac=0.27, precip_wet_cell_mm=7.0,
    precip_wet_max_frac=0.35, htop_dc_cell_min_m=2500.0, htop_dc_cover_frac=0.55,
)
COVER = """
, lead_share AS (SELECT init_h, var, lead_h, AVG(CASE WHEN value > CASE var WHEN 'cape_ml' THEN 400 WHEN 'asob_s' THEN 900 ELSE 2500 END THEN 1.0e0 ELSE 0.0e0 END) AS share
    FROM grid_cell WHERE var IN ('cape_ml', 'asob_s', 'htop_dc') AND lead_h BETWEEN 2 AND 6 GROUP BY 1, 2, 3)
, cover AS (SELECT init_h, var, MAX(share) AS cover FROM lead_share GROUP BY 1, 2)"""
WET = """
, hi AS (SELECT * FROM grid_cell WHERE var = 'tot_prec' AND lead_h = 6), lo AS (SELECT * FROM grid_cell WHERE var = 'tot_prec' AND lead_h = 1)
, wet AS (SELECT h.init_h, AVG(CASE WHEN h.value - COALESCE(l.value, 0) > 7 THEN 1.0e0 ELSE 0.0e0 END) AS wet_frac FROM hi h LEFT JOIN lo l USING (init_h, lat_i, lon_i) GROUP BY 1)"""


@query("g11_coverage", fx.with_sql("grid_cell", body=COVER + "SELECT init_h, var, ROUND(cover, 4) AS cover FROM cover"))
def _g11(spark, d):
    return rounded(grids.coverage(fx.grid_cell(spark, d), GATE.cells(), (2, 6)), cover=4)


@query("g12_wet_fraction", fx.with_sql("grid_cell", body=WET[1:].replace(", hi", ", hi", 1) + " SELECT init_h, ROUND(wet_frac, 4) AS wet_frac FROM wet"))
def _g12(spark, d):
    return rounded(grids.wet_fraction(fx.grid_cell(spark, d), (2, 6), 7.0), wet_frac=4)


@query(
    "g13_gate_decision",
    fx.with_sql("grid_cell", body=COVER + WET + """
    , facts AS (SELECT init_h, MAX(CASE WHEN var = 'cape_ml' THEN cover END) AS c, MAX(CASE WHEN var = 'asob_s' THEN cover END) AS r, MAX(CASE WHEN var = 'htop_dc' THEN cover END) AS h FROM cover GROUP BY 1)
    , reasons AS (SELECT init_h, c, r, h, wet_frac, CONCAT_WS(' OR ',
        CASE WHEN c > 0.5e0 THEN 'cape_cover=' || CAST(ROUND_EVEN(c * 100, 0) AS INT) || '%>50%@400' END,
        CASE WHEN r > 0.27e0 THEN 'rad_cover=' || CAST(ROUND_EVEN(r * 100, 0) AS INT) || '%>27%@900' END,
        CASE WHEN wet_frac < 0.35e0 AND h > 0.55e0 THEN 'blue_day(wet=' || CAST(ROUND_EVEN(wet_frac * 100, 0) AS INT) || '%<35%,htop_dc_cover=' || CAST(ROUND_EVEN(h * 100, 0) AS INT) || '%>55%)' END) AS why
        FROM facts FULL JOIN wet USING (init_h))
    SELECT init_h, why <> '' AS fire, CASE WHEN why <> '' THEN why ELSE 'no_threshold_met' END AS reason, ROUND(c, 4) AS cape_cover_frac, ROUND(wet_frac, 4) AS wet_frac,
      ROUND(cape_max, 2) AS cape_max_jkg, 2 AS lead_from FROM reasons LEFT JOIN (SELECT init_h, MAX(value) AS cape_max FROM grid_cell WHERE var = 'cape_ml' AND lead_h BETWEEN 2 AND 6 GROUP BY 1) USING (init_h)"""),
)
def _g13(spark, d):
    grid = fx.grid_cell(spark, d)
    parts = (grids.coverage(grid, GATE.cells(), (2, 6)), grids.wet_fraction(grid, (2, 6), 7.0), GATE)
    out = grids.gate_decision(*parts, peak=grids.cape_peak(grid, (2, 6)), leads=(2, 6), box=(5.0, 43.5, 17.0, 49.0))
    return out.select(
        "init_h", "fire", "reason", rnd("metrics.cape_cover_frac", 4).alias("cape_cover_frac"),
        rnd("metrics.wet_frac", 4).alias("wet_frac"), rnd("metrics.cape_max_jkg", 2).alias("cape_max_jkg"),
        F.col("metrics.leads")[0].alias("lead_from"),
    )


# Run times for the file queries: one per order date and 3-hour slot.
INITS = "SELECT DISTINCT CAST(o_orderdate AS DATE) + INTERVAL (CAST(o_custkey % 8 AS INT) * 3) HOUR AS init FROM orders"


def inits(spark, d):
    hours = (F.col("o_custkey") % 8 * 3).cast("int")
    start = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=hours)
    return fx.table(spark, d, "orders").select(start.alias("init")).distinct()


SURFACE_LIST = ", ".join(f"('{v}')" for v in grids.SURFACE_VARS)
PROFILE_LIST = ", ".join(f"('{v}')" for v in grids.PROFILE_VARS)


@query(
    "g14_expected_files",
    f"""WITH i AS ({INITS}),
    s AS (SELECT init, COUNT(*) AS n_files, CAST(SUM(l.lead) AS BIGINT) AS lead_sum FROM i, range(0, 49) l(lead), (VALUES {SURFACE_LIST}) v(var) GROUP BY 1),
    p AS (SELECT init, COUNT(*) AS n, CAST(SUM(lead) AS BIGINT) AS lead_sum FROM i, range(1, 13) l(lead), (VALUES {PROFILE_LIST}) v(var), range(1, 66) k(level) GROUP BY 1)
    SELECT init AS run, 'tier1' AS tier, n_files, lead_sum FROM s
    UNION ALL SELECT init, 'tier2', n + 66, lead_sum FROM p""",
)
def _g14(spark, d):
    runs = inits(spark, d)
    both = grids.expected_files(runs, "tier1").unionByName(grids.expected_files(runs, "tier2"))
    return both.groupBy("run", "tier").agg(
        F.count("*").alias("n_files"), F.sum("lead_h").alias("lead_sum")
    )


@query(
    "g14_file_key",
    """WITH k AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL (CAST(o_custkey % 24 AS INT)) HOUR AS init, CAST(o_orderkey % 53 AS INT) AS lead_h,
      CASE o_custkey % 3 WHEN 0 THEN 't_2m' WHEN 1 THEN 'qv' ELSE 'hhl' END AS var,
      CASE o_custkey % 3 WHEN 0 THEN 'single-level' WHEN 1 THEN 'model-level' ELSE 'time-invariant' END AS level_type,
      CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 65 AS INT) + 1 END AS level FROM orders)
    SELECT o_orderkey, 'icon-d2_germany_regular-lat-lon_' || level_type || '_' || STRFTIME(init, '%Y%m%d%H') || '_' || LPAD(CAST(lead_h AS VARCHAR), 3, '0') || '_' ||
      CASE WHEN level_type = 'single-level' THEN '2d_' || var ELSE CONCAT_WS('_', CAST(level AS VARCHAR), var) END || '.grib2' AS file_name,
      'https://opendata.dwd.de/weather/nwp/icon-d2/grib/' || STRFTIME(init, '%H') || '/' || var || '/icon-d2_germany_regular-lat-lon_' || level_type || '_' || STRFTIME(init, '%Y%m%d%H') || '_' || LPAD(CAST(lead_h AS VARCHAR), 3, '0') || '_' ||
      CASE WHEN level_type = 'single-level' THEN '2d_' || var ELSE CONCAT_WS('_', CAST(level AS VARCHAR), var) END || '.grib2.bz2' AS url,
      CASE WHEN HOUR(init) % 3 <> 0 THEN 'init hour' WHEN lead_h > 48 THEN 'lead' WHEN level_type = 'single-level' AND level IS NOT NULL THEN 'level on a single-level file'
        WHEN level_type <> 'single-level' AND level IS NULL THEN 'level missing' END AS invalid FROM k""",
)
def _g14_key(spark, d):
    kind = F.col("o_custkey") % 3
    keys = fx.table(spark, d, "orders").select(
        "o_orderkey",
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(F.col("o_custkey") % 24).cast("int"))).alias("init"),
        (F.col("o_orderkey") % 53).cast("int").alias("lead_h"),
        F.when(kind == 0, "t_2m").when(kind == 1, "qv").otherwise("hhl").alias("var"),
        F.when(kind == 0, "single-level").when(kind == 1, "model-level").otherwise("time-invariant").alias("level_type"),
        F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 65 + 1).cast("int")).alias("level"),
    )
    return grids.file_key(keys).select("o_orderkey", "file_name", "url", "invalid")


@query(
    "g15_file_completeness",
    fx.with_sql("grid_cell", body="""
    , base AS (SELECT DISTINCT init_h, lat_i, lon_i FROM grid_cell)
    , expected AS (SELECT b.*, l.lead_h, v.var FROM base b, range(0, 7) l(lead_h), (VALUES ('asob_s'), ('cape_ml'), ('htop_dc'), ('tot_prec')) v(var))
    , present AS (SELECT init_h, lead_h, var, lat_i, lon_i, CASE WHEN (lat_i + lon_i) % 11 = 0 THEN 'timeout' END AS error, CAST(FLOOR(value) AS BIGINT) AS bytes FROM grid_cell)
    SELECT init_h, var, COUNT(*) AS files_attempted, CAST(SUM(CASE WHEN p.bytes IS NOT NULL AND error IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS files_ok,
      CAST(SUM(CASE WHEN p.bytes IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS files_missing, CAST(SUM(CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS files_error,
      CAST(SUM(CASE WHEN error IS NULL THEN COALESCE(bytes, 0) ELSE 0 END) AS BIGINT) AS bytes_on_disk
    FROM expected LEFT JOIN present p USING (init_h, lead_h, var, lat_i, lon_i) GROUP BY 1, 2"""),
)
def _g15(spark, d):
    grid = fx.grid_cell(spark, d)
    expected = grids.scaffold(grid.select("init_h", "lat_i", "lon_i").distinct(), (0, 6), VARS)
    present = grid.select(
        "init_h", "lead_h", "var", "lat_i", "lon_i",
        F.when((F.col("lat_i") + F.col("lon_i")) % 11 == 0, "timeout").alias("error"), F.floor("value").alias("bytes"),
    )
    return grids.file_completeness(expected, present, ["init_h", "lead_h", "var", "lat_i", "lon_i"], ["init_h", "var"])


INTERP = """
, zs AS (SELECT CAST(z AS INT) AS z_m FROM range(0, 6100, 100) r(z))
, ends AS (SELECT region_id, MIN(height_m) AS z0, MAX(height_m) AS z1, ARG_MIN(theta_k, height_m) AS t0, ARG_MAX(theta_k, height_m) AS t1 FROM profile GROUP BY 1)
, pairs AS (SELECT *, LEAD(height_m) OVER w AS z_up, LEAD(theta_k) OVER w AS t_up FROM profile WINDOW w AS (PARTITION BY region_id ORDER BY height_m))
, layers AS (SELECT e.region_id, z_m, CASE WHEN z_m <= z0 THEN t0 WHEN z_m >= z1 THEN t1 ELSE p.theta_k + (z_m - p.height_m) / (p.z_up - p.height_m) * (p.t_up - p.theta_k) END AS theta_k,
    z_m >= z0 AND z_m <= z1 AS in_range FROM ends e CROSS JOIN zs LEFT JOIN pairs p ON p.region_id = e.region_id AND p.height_m <= z_m AND z_m < p.z_up)"""


@query("g16_interp_profile", fx.with_sql("profile", body=INTERP + "SELECT region_id, z_m, ROUND(theta_k, 4) AS theta_k, in_range FROM layers"))
def _g16(spark, d):
    return rounded(grids.interp_profile(fx.profile(spark, d), ["region_id"], ["theta_k"], 100, 0, 6000), theta_k=4)


STATION = "(p_partkey % 60 < 20 OR p_partkey % 3 = 0)"


def _layers_sql(tag: str, where: str) -> str:
    return f"""
, src_{tag} AS (SELECT CAST(FLOOR(p_partkey / 60.0e0) AS BIGINT) AS region_id, 250.0e0 + 45.0e0 * (p_partkey % 60) AS h, 295.0e0 - 0.2e0 * (p_partkey % 60) AS t,
    296.0e0 - 0.2e0 * (p_partkey % 60) - 0.4e0 * p_size AS td FROM part WHERE {where})
, ends_{tag} AS (SELECT region_id, MIN(h) AS z0, MAX(h) AS z1, ARG_MIN(t, h) AS t0, ARG_MAX(t, h) AS t1, ARG_MIN(td, h) AS td0, ARG_MAX(td, h) AS td1 FROM src_{tag} GROUP BY 1)
, pairs_{tag} AS (SELECT *, LEAD(h) OVER w AS z_up, LEAD(t) OVER w AS t_up, LEAD(td) OVER w AS td_up FROM src_{tag} WINDOW w AS (PARTITION BY region_id ORDER BY h))
, lay_{tag} AS (SELECT e.region_id, z_m, CASE WHEN z_m <= z0 THEN t0 WHEN z_m >= z1 THEN t1 ELSE p.t + (z_m - p.h) / (p.z_up - p.h) * (p.t_up - p.t) END AS t_{tag},
    CASE WHEN z_m <= z0 THEN td0 WHEN z_m >= z1 THEN td1 ELSE p.td + (z_m - p.h) / (p.z_up - p.h) * (p.td_up - p.td) END AS td_{tag},
    CASE WHEN z_m >= z0 AND z_m <= z1 THEN 1.0e0 ELSE 0.0e0 END AS ok_{tag}
    FROM ends_{tag} e CROSS JOIN (SELECT CAST(z AS INT) AS z_m FROM range(200, 5100, 100) r(z)) LEFT JOIN pairs_{tag} p ON p.region_id = e.region_id AND p.h <= z_m AND z_m < p.z_up)"""


@query(
    "g17_blend_soundings",
    "WITH" + _layers_sql("st", STATION)[2:] + _layers_sql("rs", "NOT " + STATION) + """
    , j AS (SELECT region_id, z_m, COALESCE(t_st, 0) AS st, COALESCE(td_st, 0) AS std, COALESCE(t_rs, 0) AS rt, COALESCE(td_rs, 0) AS rtd, COALESCE(ok_st, 0) AS sok, COALESCE(ok_rs, 0) AS rok FROM lay_st FULL JOIN lay_rs USING (region_id, z_m))
    , w AS (SELECT *, LEAST(1.0e0, z_m / 2300.0e0) * rok AS wr, (1.0e0 - LEAST(1.0e0, z_m / 2300.0e0)) * sok AS ws FROM j)
    , f AS (SELECT *, CASE WHEN wr + ws = 0 THEN rok ELSE wr END AS fr, CASE WHEN wr + ws = 0 AND rok = 0 THEN sok ELSE ws END AS fs FROM w)
    , m AS (SELECT region_id, z_m, CASE WHEN fr + fs > 0 THEN (fs * st + fr * rt) / (fr + fs) END AS t, CASE WHEN fr + fs > 0 THEN (fs * std + fr * rtd) / (fr + fs) END AS td FROM f)
    SELECT region_id, z_m, ROUND(t, 4) AS t_k, ROUND(CASE WHEN td > t THEN t ELSE td END, 4) AS td_k FROM m""",
)
def _g17(spark, d):
    key = F.col("p_partkey")
    level = key % 60
    src = fx.table(spark, d, "part").select(
        F.floor(key / F.lit(60.0)).alias("region_id"), ((level < 20) | (key % 3 == 0)).alias("station"),
        (250.0 + 45.0 * level).alias("height_m"), (295.0 - 0.2 * level).alias("t_k"),
        (296.0 - 0.2 * level - 0.4 * F.col("p_size")).alias("td_k"),
    )

    def layered(df):
        return grids.interp_profile(df, ["region_id"], ["t_k", "td_k"], 100, 200, 5000)

    blended = grids.blend_soundings(layered(src.where("station")), layered(src.where("NOT station")), ["region_id"])
    return rounded(blended.select("region_id", "z_m", "t_k", "td_k"), t_k=4, td_k=4)


@query(
    "g18_due_inits",
    """WITH nows AS (SELECT DISTINCT DATE_TRUNC('minute', ts) AS now FROM events),
    slots AS (SELECT now, CAST(a AS INT) AS anchor_h, DATE_TRUNC('day', now) + INTERVAL (CAST(a AS INT)) HOUR AS today FROM nows, (VALUES (0), (3), (6), (9)) v(a))
    SELECT now, anchor_h, CASE WHEN now >= today + INTERVAL 150 MINUTE THEN today ELSE today - INTERVAL 1 DAY END - INTERVAL (CAST(b AS INT)) DAY AS init FROM slots, range(0, 3) r(b)""",
)
def _g18(spark, d):
    nows = fx.table(spark, d, "events").select(F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("now")).distinct()
    return grids.due_inits(nows, 3)


# -- scalar columns ----------------------------------------------------------

ES = "6.112e0 * EXP(17.62e0 * ({t} - 273.15e0) / (243.12e0 + {t} - 273.15e0))"
AIR_SQL = f"""
, a AS (SELECT *, 101325.0e0 * POW(1 - 0.0065e0 * z_m / 288.15e0, 9.80665e0 / (287.04e0 * 0.0065e0)) AS p, {ES.format(t='td_k')} AS e, {ES.format(t='t_k')} AS es FROM sounding)
, b AS (SELECT *, t_k * POW(100000.0e0 / p, 287.04e0 / 1005.0e0) AS theta, (287.04e0 / 461.5e0) * e * 100 / (p - e * 100) AS r, (287.04e0 / 461.5e0) * es * 100 / (p - es * 100) AS rs FROM a)"""


@query(
    "p13_moist_air_columns",
    fx.with_sql("sounding", body=AIR_SQL + """SELECT sample_id, ROUND(p, 2) AS p_pa, ROUND(e, 4) AS e_hpa, ROUND(theta, 4) AS theta_k, ROUND(r, 8) AS r_vapour, ROUND(rs, 8) AS r_saturated,
    ROUND(e / es, 5) AS relative_humidity, ROUND(z_m + 125 * GREATEST(t_k - td_k, 0), 3) AS lcl_m,
    ROUND(9.80665e0 * (1 + 2.5e6 * rs / (287.04e0 * t_k)) / (1005.0e0 + 2.5e6 * 2.5e6 * rs * (287.04e0 / 461.5e0) / (287.04e0 * t_k * t_k)), 8) AS lapse_k_m,
    ROUND(t_k, 3) AS t_back_k, ROUND(td_k, 3) AS td_back_k, ROUND(t_k * (1 + r / (287.04e0 / 461.5e0)) / (1 + r), 4) AS t_virtual_k,
    ROUND(t_k * (1 + r / (287.04e0 / 461.5e0)) / (1 + r + r_liquid), 4) AS t_density_k,
    ROUND(p / (287.04e0 * t_k * (1 + r / (287.04e0 / 461.5e0)) / (1 + r + r_liquid)), 6) AS density_kg_m3 FROM b"""),
)
def _p13(spark, d):
    out = air.moist_air_columns(fx.sounding(spark, d)).drop("z_m", "t_k", "td_k", "r_liquid")
    return rounded(
        out, p_pa=2, e_hpa=4, theta_k=4, r_vapour=8, r_saturated=8, relative_humidity=5, lcl_m=3, lapse_k_m=8,
        t_back_k=3, td_back_k=3, t_virtual_k=4, t_density_k=4, density_kg_m3=6,
    )


@query(
    "p14_flux_regime_columns",
    fx.with_sql("sounding", body=""", x AS (SELECT sample_id, (sample_id % 200) - 40.0e0 AS f, 1000.0e0 * (sample_id % 77) AS h, CAST(sample_id % 97 AS DOUBLE) AS u, sample_id % 2 = 0 AS acc FROM sounding)
    , y AS (SELECT *, CASE WHEN f <= 0 THEN 0.0e0 WHEN f >= 75 THEN 0.5e0 ELSE 0.5e0 * f / 75 END AS dt FROM x)
    SELECT sample_id, ROUND(dt, 6) AS delta_t_k, ROUND(CASE WHEN dt <= 0 OR h <= 0 THEN 0.0e0 ELSE h / (1005 * dt) END, 4) AS parcel_mass_kg,
      ROUND(LEAST(1.0e0, GREATEST(0.0e0, 1 - 1.65e-4 * u * u)), 6) AS wind_factor, CASE WHEN acc THEN 0.0025e0 ELSE 0.008e0 END AS mixing_per_m FROM y"""),
)
def _p14(spark, d):
    key = F.col("sample_id")
    df = fx.sounding(spark, d).select(
        key, ((key % 200) - 40.0).alias("flux_w_m2"), (1000.0 * (key % 77)).alias("heat_j"),
        (key % 97).cast("double").alias("wind_kmh"), (key % 2 == 0).alias("accelerating"),
    )
    out = air.flux_regime_columns(df).select("sample_id", "delta_t_k", "parcel_mass_kg", "wind_factor", "mixing_per_m")
    return rounded(out, delta_t_k=6, parcel_mass_kg=4, wind_factor=6)


def _skin_round(i: int) -> str:
    prev = "t_k" if i == 0 else f"skin{i - 1}"
    table = "q" if i == 0 else f"k{i - 1}"
    return f""", k{i} AS (SELECT *, t_k + 0.005e0 * net{i} AS skin{i} FROM (SELECT *, short - 5.67e-8 * (POW({prev}, 4) - sky * POW(t_k, 4)) AS net{i} FROM {table}))"""


@query(
    "p15_clear_sky_flux_columns",
    fx.with_sql("sounding", body=f""", x AS (SELECT *, 44.0e0 + sample_id % 5 AS lat, sample_id % 365 + 1 AS doy, CAST(sample_id % 24 AS DOUBLE) AS hh FROM sounding)
    , y AS (SELECT *, RADIANS(23.44e0 * SIN(RADIANS(360.0e0 * (284 + doy) / 365.0e0))) AS dec FROM x)
    , z AS (SELECT *, GREATEST(0.0e0, SIN(RADIANS(lat)) * SIN(dec) + COS(RADIANS(lat)) * COS(dec) * COS(RADIANS(15 * (hh - 12)))) AS s,
        GREATEST(1e-6, SIN(RADIANS(lat)) * SIN(dec) + COS(RADIANS(lat)) * COS(dec)) AS smax FROM y)
    , q AS (SELECT *, CASE WHEN s <= 0 THEN 0.0e0 ELSE 1200.0e0 * s * EXP(-0.323e0 * EXP(-z_m / 2333.0e0) * smax / CASE WHEN s <= 0 THEN 1 ELSE s END) * 0.85e0 END AS short, 0.594e0 + 0.0416e0 * SQRT({ES.format(t='td_k')}) AS sky FROM z)
    {_skin_round(0)}{_skin_round(1)}{_skin_round(2)}
    SELECT sample_id, ROUND(s, 6) AS sin_elevation, ROUND(net2, 3) AS net_w_m2, ROUND(0.4e0 * 0.85e0 * net2, 3) AS sensible_w_m2, ROUND(0.6e0 * 0.85e0 * net2, 3) AS latent_w_m2, ROUND(skin2, 4) AS t_skin_k FROM k2"""),
)
def _p15(spark, d):
    key = F.col("sample_id")
    df = fx.sounding(spark, d).withColumns(
        {"lat": 44.0 + key % 5, "day_of_year": key % 365 + 1, "solar_hour": (key % 24).cast("double")}
    )
    out = solar.clear_sky_flux_columns(df)
    out = out.select("sample_id", "sin_elevation", "net_w_m2", "sensible_w_m2", "latent_w_m2", "t_skin_k")
    return rounded(out, sin_elevation=6, net_w_m2=3, sensible_w_m2=3, latent_w_m2=3, t_skin_k=4)


@query(
    "p16_qv_to_dewpoint",
    fx.with_sql("sounding", body=AIR_SQL + """, q AS (SELECT *, CASE WHEN sample_id % 10 = 0 THEN NULL ELSE 0.0005e0 * (sample_id % 30) END AS qv FROM b)
    , w AS (SELECT *, qv / GREATEST(1 - qv, 1e-9) AS rr FROM q), v AS (SELECT *, LN(GREATEST(rr * p / 100 / (287.04e0 / 461.5e0 + rr), 1e-6) / 6.112e0) AS lg FROM w)
    SELECT sample_id, ROUND(CASE WHEN qv IS NULL THEN t_k - 5 ELSE 243.12e0 * lg / (17.62e0 - lg) + 273.15e0 END, 4) AS td_k FROM v"""),
)
def _p16(spark, d):
    qv = F.when(F.col("sample_id") % 10 != 0, 0.0005 * (F.col("sample_id") % 30))
    td = air.qv_to_dewpoint(qv, air.standard_pressure(F.col("z_m")), F.col("t_k"))
    return fx.sounding(spark, d).select("sample_id", rnd(td, 4).alias("td_k"))


# -- grid filters ------------------------------------------------------------


@query(
    "p7_bbox_filter",
    fx.with_sql("grid_cell", body="""SELECT lat_i, lon_i, COUNT(*) AS n FROM grid_cell WHERE lat BETWEEN 45.0e0 AND 47.3e0 AND lon BETWEEN 7.0e0 AND 12.0e0 GROUP BY 1, 2"""),
)
def _p7(spark, d):
    kept = filters.bbox_filter(fx.grid_cell(spark, d), filters.BBox(7.0, 45.0, 12.0, 47.3))
    return kept.groupBy("lat_i", "lon_i").agg(F.count("*").alias("n"))


@query(
    "p8_enclosing_circle",
    fx.with_sql("grid_cell", body="""SELECT lat_i, lon_i, COUNT(*) AS n FROM grid_cell
    WHERE 2 * 6371000.0e0 * ASIN(LEAST(1.0e0, SQRT(POW(SIN(RADIANS(lat - 46.0e0) / 2), 2) + COS(RADIANS(46.0e0)) * COS(RADIANS(lat)) * POW(SIN(RADIANS(lon - 9.0e0) / 2), 2)))) <= 161000 GROUP BY 1, 2"""),
)
def _p8(spark, d):
    lat, lon, radius = filters.enclosing_circle(filters.BBox(8.0, 45.0, 10.0, 47.0))
    kept = filters.circle_filter(fx.grid_cell(spark, d), lat, lon, radius)
    return kept.groupBy("lat_i", "lon_i").agg(F.count("*").alias("n"))


@query(
    "p10_full_hour_only",
    fx.with_sql("grid_cell", body="SELECT init_h, var, COUNT(*) AS n FROM grid_cell WHERE (lat_i % 4) * 15 = 0 GROUP BY 1, 2"),
)
def _p10(spark, d):
    stepped = fx.grid_cell(spark, d).withColumn("substep_min", F.col("lat_i") % 4 * 15)
    return filters.full_hour_only(stepped).groupBy("init_h", "var").agg(F.count("*").alias("n"))


@query(
    "p11_lead_window",
    fx.with_sql("grid_cell", body="SELECT init_h, lead_h, COUNT(*) AS n FROM grid_cell WHERE lead_h BETWEEN 2 AND 5 GROUP BY 1, 2"),
)
def _p11(spark, d):
    kept = filters.lead_window(fx.grid_cell(spark, d), 2, 5, ["init_h", "var"])
    return kept.groupBy("init_h", "lead_h").agg(F.count("*").alias("n"))
