from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from updraft import fixtures
from updraft.functions import air
from updraft.operators import grids, heat

PROFILE = "region_id INT, height_m DOUBLE, theta_k DOUBLE"


def profile(spark, z, theta, region=0):
    return spark.createDataFrame([(region, float(a), float(b)) for a, b in zip(z, theta)], PROFILE)


def tops(spark, prof, amounts):
    heats = spark.createDataFrame([(0, float(h)) for h in amounts], "region_id INT, heat_cum_j_m2 DOUBLE")
    out = heat.heat_to_top(heat.heat_capacity_curve(prof, ["region_id"]), heats, ["region_id"])
    return {r.heat_cum_j_m2: (r.z_top_m, r.theta_mixed_k) for r in out.collect()}


def test_linear_profile_grows_with_the_root_of_heat(spark):
    z = np.linspace(500, 3500, 601)
    prof = profile(spark, z, 290 + 0.005 * (z - 500))
    got = tops(spark, prof, [0.0, -5.0, 1e6, 4e6, 1e9])
    assert got[0.0] == got[-5.0] == (500.0, 290.0)
    for h in (1e6, 4e6):
        assert got[h][0] - 500 == pytest.approx((2 * h / (air.C_P * 0.005)) ** 0.5, rel=2e-3)
    assert got[1e9] == (3500.0, pytest.approx(305.0))


def test_curve_equals_the_double_loop(spark):
    rng = np.random.default_rng(2)
    z = np.cumsum(rng.uniform(20, 200, 40))
    theta = 288 + np.cumsum(rng.uniform(-0.1, 0.6, 40))
    want = []
    for k in range(40):
        gap = theta[k] - theta[: k + 1]
        want.append(air.C_P * float(np.sum((gap[:-1] + gap[1:]) / 2 * np.diff(z[: k + 1]))))
    got = heat.heat_capacity_curve(profile(spark, z, theta), ["region_id"]).orderBy("step").collect()
    assert [r.heat_j_m2 for r in got] == pytest.approx(want, abs=1e-3)


def test_dipping_curve_takes_the_first_crossing(spark):
    z, theta = [0, 100, 200, 300, 400], [290, 292, 291.5, 293, 296]
    prof = profile(spark, z, theta)
    curve = [r.heat_j_m2 for r in heat.heat_capacity_curve(prof, ["region_id"]).orderBy("step").collect()]
    for h in np.linspace(1000, curve[-1] * 0.999, 23):
        k = next(i for i, g in enumerate(curve) if g >= h)
        z_want = z[k - 1] + (h - curve[k - 1]) / (curve[k] - curve[k - 1]) * 100
        assert tops(spark, prof, [h])[float(h)][0] == pytest.approx(z_want)


def test_unordered_heights_stop_the_query(spark):
    with pytest.raises(Exception, match="strictly rising"):
        heat.heat_capacity_curve(profile(spark, [0, 0, 50], [1, 2, 3]), ["region_id"]).collect()


def series(spark, values):
    rows = [(0, 3600.0 * i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "region_id INT, lead_s DOUBLE, mean DOUBLE")


def fluxes(spark, values):
    return [r.flux for r in grids.deaverage(series(spark, values), ["region_id"]).orderBy("lead_s").collect()]


def test_constant_and_ramp_fluxes(spark):
    assert fluxes(spark, [None, 200.0, 200.0, 200.0]) == [0.0, 200.0, 200.0, 200.0]
    assert fluxes(spark, [0.0, 50.0, 100.0, 150.0]) == pytest.approx([0.0, 50.0, 150.0, 250.0])


def test_a_gap_empties_its_interval_and_the_next(spark):
    assert fluxes(spark, [0.0, 10.0, None, 10.0, 10.0]) == [0.0, 10.0, None, None, 10.0]


def test_series_must_start_at_zero(spark):
    with pytest.raises(Exception, match="start at lead 0"):
        grids.deaverage(series(spark, [1.0, 2.0]).where("lead_s > 0"), ["region_id"]).collect()


def test_missing_flux_leaves_the_heat_unknown(spark):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate([10.0, -5.0, None, 10.0])], "k INT, lead_h INT, flux_w_m2 DOUBLE")
    got = heat.cumulative_heat(rows, ["k"], 1.0).orderBy("lead_h").collect()
    assert [r.heat_cum_j_m2 for r in got] == [10.0, 10.0, None, None]


def test_file_counts_and_names(spark):
    init = spark.createDataFrame([(dt.datetime(2026, 5, 25, 6),)], "init TIMESTAMP")
    surface, levels = grids.expected_files(init, "tier1"), grids.expected_files(init, "tier2")
    assert surface.count() == 833 and levels.count() == 4746
    names = {r.file_name for r in grids.file_key(surface).where("lead_h = 3 AND var = 't_2m'").collect()}
    assert names == {"icon-d2_germany_regular-lat-lon_single-level_2026052506_003_2d_t_2m.grib2"}
    half = grids.file_key(levels).where("var = 'hhl' AND level = 66").first()
    assert half.file_name == "icon-d2_germany_regular-lat-lon_time-invariant_2026052500_000_66_hhl.grib2"
    assert grids.file_key(levels).where("invalid IS NOT NULL").count() == 0


def test_region_without_cells_is_an_error(spark):
    ring = [[(50.0, 50.0), (51.0, 50.0), (51.0, 51.0), (50.0, 50.0)]]
    regions = spark.createDataFrame([(1, 0, ring)], "region_id INT, ord INT, rings ARRAY<ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>>")
    cells = spark.createDataFrame([(0, 0, 46.0, 8.0)], "lat_i INT, lon_i INT, lat DOUBLE, lon DOUBLE")
    with pytest.raises(Exception, match="no grid cell"):
        grids.region_cell_map(cells, regions).collect()


def test_interpolation_equals_numpy(spark):
    z, v = np.array([130.0, 300.0, 410.0, 999.0]), np.array([1.0, 5.0, 2.0, 8.0])
    rows = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(z, v)], "k INT, height_m DOUBLE, v DOUBLE")
    got = grids.interp_profile(rows, ["k"], ["v"], 100, 0, 1300).orderBy("z_m").collect()
    layers = np.arange(0, 1301, 100)
    assert [r.z_m for r in got] == list(layers)
    assert [r.v for r in got] == pytest.approx(np.interp(layers, z, v))
    assert [r.in_range for r in got] == [bool(130 <= a <= 999) for a in layers]


def test_nan_becomes_null_at_ingest(spark):
    df = grids.null_if_nan(spark.createDataFrame([(float("nan"),), (1.0,)], "value DOUBLE"), "value")
    assert sorted([r.value for r in df.collect()], key=str) == [1.0, None]


def test_field_means_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    # Sums of these quantities over 25, added one by one as doubles, stay below the whole mean.
    rows = [(0, 0, 3, 1, float(q), 1.0) for q in (18, 18, 31, 45, 20, 18)]
    schema = "l_orderkey LONG, l_partkey LONG, l_suppkey LONG, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    (cell,) = fixtures.grid_cell(spark, str(tmp_path)).collect()
    assert cell.value == 1.0


def test_gate_reports_every_branch_and_none(spark):
    cover = spark.createDataFrame([(0, "cape_ml", 0.125), (0, "asob_s", 0.5), (0, "htop_dc", 0.3), (3, "cape_ml", 0.1)], "init_h INT, var STRING, cover DOUBLE")
    wet = spark.createDataFrame([(0, 0.05)], "init_h INT, wet_frac DOUBLE")
    got = {r.init_h: (r.fire, r.reason) for r in grids.gate_decision(cover, wet).collect()}
    assert got[0] == (True, "cape_cover=12%>10%@500 OR rad_cover=50%>25%@600 OR blue_day(wet=5%<10%,htop_dc_cover=30%>20%)")
    assert got[3] == (False, "no_threshold_met")


def test_air_reference_points(spark):
    row = spark.range(1).select(
        air.standard_pressure(F.lit(0.0)).alias("p0"), air.standard_pressure(F.lit(5500.0)).alias("p5"),
        air.saturation_vapour_pressure(F.lit(273.15)).alias("es"), air.lcl_height(F.lit(290.0), F.lit(295.0), F.lit(500.0)).alias("lcl"),
        air.moist_lapse_rate(F.lit(288.0), F.lit(1e5)).alias("moist"), air.convective_velocity(F.lit(-1.0), F.lit(5.0), F.lit(300.0)).alias("w"),
    ).first()
    assert row.p0 == 101325.0 and row.p5 == pytest.approx(50500, abs=200)
    assert row.es == pytest.approx(6.112) and row.lcl == 500.0 and row.w == 0.0
    assert 0.004 < row.moist < 9.81 / 1005


@pytest.mark.parametrize("spread", [1.0, 40.0])
def test_nearest_point_of_a_turned_grid(spark, spread):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:15, 0:20].reshape(2, -1) * 0.07
    lat, lon = 46 + 0.9 * y - 0.4 * x, 10 + 0.4 * y + 0.9 * x
    cells = spark.createDataFrame([(int(k // 20), int(k % 20), float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lon))], "lat_i INT, lon_i INT, lat DOUBLE, lon DOUBLE")
    pts = rng.uniform(-spread, spread, (200, 2)) + [46.4, 10.8]
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)] + [(200, None, 1.0)], "region_id INT, lat DOUBLE, lon DOUBLE")
    got = {r.region_id: r.lat_i * 20 + r.lon_i for r in grids.nearest_grid_point(cells, points).collect()}
    want = ((pts[:, None] - np.column_stack([lat, lon])) ** 2).sum(axis=2).argmin(axis=1)
    assert got == dict(enumerate(want.tolist()))


def test_nearest_row_and_column_without_any_cell(spark):
    cells = spark.createDataFrame([], "lat_i INT, lon_i INT, lat DOUBLE, lon DOUBLE")
    points = spark.createDataFrame([(1, 46.0, 10.0)], "region_id INT, lat DOUBLE, lon DOUBLE")
    assert grids.nearest_cell(cells, points).collect() == [] and grids.nearest_grid_point(cells, points).collect() == []
