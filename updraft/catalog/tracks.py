"""Track and phase queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from updraft import fixtures as fx
from updraft.catalog.registry import query, rnd, rounded
from updraft.functions.geo import bearing_deg, haversine_m, signed_turn
from updraft.operators import filters, phases, tracks
from updraft.session import cut_lineage

R = "6371000.0e0"


def _hav(a: str, b: str) -> str:
    """Haversine distance in SQL between two row aliases."""
    return (
        f"2 * {R} * ASIN(LEAST(1.0e0, SQRT(POW(SIN(RADIANS({b}.lat - {a}.lat) / 2), 2) + "
        f"COS(RADIANS({a}.lat)) * COS(RADIANS({b}.lat)) * POW(SIN(RADIANS({b}.lon - {a}.lon) / 2), 2))))"
    )


SOARING = ", obs_s AS (SELECT * FROM obs WHERE aircraft_type IN (1, 6, 7))"
CONSENSUS = """, merged AS (SELECT day, source_id, t_s, MIN(aircraft_type) AS aircraft_type, MEDIAN(lat) AS lat, MEDIAN(lon) AS lon,
  MEDIAN(alt_m) AS alt_m FROM obs_s GROUP BY day, source_id, t_s)"""


def _pass(src: str, dst: str) -> str:
    """Sequential jump rejection in SQL: one recursion step per input fix."""
    return f"""
, {dst}_in AS (SELECT *, ROW_NUMBER() OVER w AS i, COUNT(*) OVER (PARTITION BY day, source_id) AS n,
    LEAD(t_s) OVER w AS nt, LEAD(lat) OVER w AS nlat, LEAD(lon) OVER w AS nlon, LEAD(alt_m) OVER w AS nalt
    FROM {src} WINDOW w AS (PARTITION BY day, source_id ORDER BY t_s))
, {dst}_walk AS (
    SELECT day, source_id, i, t_s AS kt, lat AS klat, lon AS klon, alt_m AS kalt, TRUE AS kept FROM {dst}_in WHERE i = 1
    UNION ALL
    SELECT c.day, c.source_id, c.i,
      CASE WHEN d.drop_it THEN k.kt ELSE c.t_s END, CASE WHEN d.drop_it THEN k.klat ELSE c.lat END,
      CASE WHEN d.drop_it THEN k.klon ELSE c.lon END, CASE WHEN d.drop_it THEN k.kalt ELSE c.alt_m END, NOT d.drop_it
    FROM {dst}_walk k JOIN {dst}_in c ON c.day = k.day AND c.source_id = k.source_id AND c.i = k.i + 1,
    LATERAL (SELECT c.i < c.n AND ((
        2 * {R} * ASIN(LEAST(1.0e0, SQRT(POW(SIN(RADIANS(c.lat - k.klat) / 2), 2) + COS(RADIANS(k.klat)) * COS(RADIANS(c.lat)) * POW(SIN(RADIANS(c.lon - k.klon) / 2), 2)))) / (c.t_s - k.kt) > 70
        AND 2 * {R} * ASIN(LEAST(1.0e0, SQRT(POW(SIN(RADIANS(c.nlat - c.lat) / 2), 2) + COS(RADIANS(c.lat)) * COS(RADIANS(c.nlat)) * POW(SIN(RADIANS(c.nlon - c.lon) / 2), 2)))) / (c.nt - c.t_s) > 70)
      OR (ABS(c.alt_m - k.kalt) / (c.t_s - k.kt) > 15 AND ABS(c.nalt - c.alt_m) / (c.nt - c.t_s) > 15)) AS drop_it) d)
, {dst} AS (SELECT s.day, s.source_id, s.t_s, s.aircraft_type, s.lat, s.lon, s.alt_m FROM {dst}_in s JOIN {dst}_walk k
    ON s.day = k.day AND s.source_id = k.source_id AND s.i = k.i WHERE k.kept)"""


SPIKES = _pass("merged", "once") + _pass("once", "twice")
CLEAN = """
, clean AS (SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY day, source_id) AS n FROM twice) WHERE n >= 20)"""
BEARINGS = f"""
, legs AS (SELECT *, (DEGREES(ATAN2(
      SIN(RADIANS(nlon - lon)) * COS(RADIANS(nlat)),
      COS(RADIANS(lat)) * SIN(RADIANS(nlat)) - SIN(RADIANS(lat)) * COS(RADIANS(nlat)) * COS(RADIANS(nlon - lon)))) + 360.0e0) % 360.0e0 AS bout
    FROM (SELECT *, LEAD(lat) OVER w AS nlat, LEAD(lon) OVER w AS nlon FROM clean WINDOW w AS (PARTITION BY day, source_id ORDER BY t_s)))
, turns AS (SELECT *, CASE WHEN bin IS NULL OR bout IS NULL THEN NULL ELSE ((bout - bin + 180.0e0) % 360.0e0 + 360.0e0) % 360.0e0 - 180.0e0 END AS turn
    FROM (SELECT *, LAG(bout) OVER (PARTITION BY day, source_id ORDER BY t_s) AS bin FROM legs))"""
ROLLED = f"""
, rolled AS (SELECT *, CASE WHEN turn IS NOT NULL THEN SUM(turn) OVER (PARTITION BY day, source_id ORDER BY t_s RANGE BETWEEN 25 PRECEDING AND CURRENT ROW) END AS turn_sum,
    {R} * RADIANS(lat) AS y, {R} * RADIANS(lon) * COS(RADIANS(AVG(lat) OVER (PARTITION BY day, source_id))) AS x FROM turns)
, near AS (SELECT a.day, a.source_id, a.t_s, COUNT(*) AS k, AVG(b.x) AS cx, AVG(b.y) AS cy FROM rolled a JOIN rolled b
    ON a.day = b.day AND a.source_id = b.source_id AND b.t_s BETWEEN a.t_s - 120 AND a.t_s GROUP BY 1, 2, 3)
, reach AS (SELECT n.day, n.source_id, n.t_s, n.k, MAX(SQRT(POW(b.x - n.cx, 2) + POW(b.y - n.cy, 2))) AS r FROM near n JOIN rolled b
    ON n.day = b.day AND n.source_id = b.source_id AND b.t_s BETWEEN n.t_s - 120 AND n.t_s GROUP BY 1, 2, 3, 4)
, flagged AS (SELECT v.*, (k >= 6 AND r <= 400) AS confined FROM rolled v JOIN reach q ON v.day = q.day AND v.source_id = q.source_id AND v.t_s = q.t_s)"""
ISLANDS = """
, circ AS (SELECT *, (ABS(turn_sum) >= 180 OR confined) AS c FROM flagged WHERE turn IS NOT NULL)
, trues AS (SELECT *, LAST_VALUE(CASE WHEN c THEN t_s END IGNORE NULLS) OVER (PARTITION BY day, source_id ORDER BY t_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt,
    LAG(c) OVER w AS pc, LAG(t_s) OVER w AS prev_t FROM circ WINDOW w AS (PARTITION BY day, source_id ORDER BY t_s))
, numbered AS (SELECT *, SUM(CASE WHEN c AND (pt IS NULL OR (NOT pc AND prev_t - pt > 20)) THEN 1 ELSE 0 END) OVER (PARTITION BY day, source_id ORDER BY t_s) AS phase_no FROM trues)
, ends AS (SELECT day, source_id, phase_no, MIN(t_s) AS t0, MAX(CASE WHEN c THEN t_s END) AS t1 FROM numbered WHERE phase_no > 0 GROUP BY 1, 2, 3)
, island AS (SELECT n.*, e.t0, e.t1 FROM numbered n JOIN ends e ON n.day = e.day AND n.source_id = e.source_id AND n.phase_no = e.phase_no WHERE n.t_s <= e.t1)"""
METRICS = f"""
, means AS (SELECT day, source_id, phase_no, AVG(lat) AS mlat, AVG(lon) AS mlon FROM island GROUP BY 1, 2, 3)
, metrics AS (SELECT i.day, i.source_id, i.phase_no, MIN(aircraft_type) AS aircraft_type, MIN(t_s) AS t_start_s, MAX(t_s) AS t_end_s, MAX(t_s) - MIN(t_s) AS duration_s,
    MEDIAN(lat) AS lat_centroid, MEDIAN(lon) AS lon_centroid, AVG(alt_m) AS alt_mean_m, ARG_MIN(alt_m, t_s) AS alt_base_m, ARG_MAX(alt_m, t_s) AS alt_top_m,
    REGR_SLOPE(alt_m, CAST(t_s - t0 AS DOUBLE)) AS climb_rate_ms, SUM(turn) AS turn_total_deg, MEDIAN(CASE WHEN t_s > t0 THEN t_s - prev_t END) AS spacing_s,
    MAX(SQRT(POW({R} * RADIANS(lon - mlon) * COS(RADIANS(mlat)), 2) + POW({R} * RADIANS(lat - mlat), 2))) AS radius_m
    FROM island i JOIN means m ON i.day = m.day AND i.source_id = m.source_id AND i.phase_no = m.phase_no GROUP BY 1, 2, 3)"""
PHASES = """
, phase AS (SELECT day, source_id, aircraft_type, t_start_s, t_end_s, duration_s, lat_centroid, lon_centroid, alt_mean_m, alt_base_m, alt_top_m, climb_rate_ms,
    CASE WHEN spacing_s <= 7 THEN ABS(turn_total_deg) / 360 ELSE duration_s / 20.0e0 END AS n_turns,
    CASE WHEN turn_total_deg >= 0 THEN 1 ELSE -1 END AS turn_sign,
    CASE WHEN spacing_s <= 7 AND ABS(turn_total_deg) / 360 >= 2 THEN 'turn' ELSE 'confined' END AS method
    FROM metrics WHERE duration_s >= 120 AND ABS(climb_rate_ms) <= 8
      AND ((spacing_s <= 7 AND ABS(turn_total_deg) / 360 >= 2) OR (radius_m <= 400 AND alt_top_m - alt_base_m >= 80)))"""
# The type of a track's first packet, by receiver within a second.
FIRST_TYPE = """, first_type AS (SELECT day, source_id, ARG_MIN(aircraft_type, t_s * 10 + rx) AS aircraft_type FROM obs_s GROUP BY 1, 2)
, typed AS (SELECT m.* REPLACE (f.aircraft_type AS aircraft_type) FROM merged m JOIN first_type f USING (day, source_id))"""
TO_CLEAN_TYPED = SOARING + CONSENSUS + FIRST_TYPE + _pass("typed", "once") + _pass("once", "twice") + CLEAN
TO_CLEAN = SOARING + CONSENSUS + SPIKES + CLEAN
TO_PHASE_TYPED = TO_CLEAN_TYPED + BEARINGS + ROLLED + ISLANDS + METRICS + PHASES
TO_PHASE = TO_CLEAN + BEARINGS + ROLLED + ISLANDS + METRICS + PHASES
FIX_OUT = "day, source_id, t_s, ROUND(lat, 4) AS lat, ROUND(lon, 4) AS lon, ROUND(alt_m, 2) AS alt_m"
PHASE_OUT = """day, source_id, aircraft_type, t_start_s, t_end_s, duration_s, ROUND(lat_centroid, 4) AS lat_centroid, ROUND(lon_centroid, 4) AS lon_centroid,
 ROUND(alt_mean_m, 3) AS alt_mean_m, ROUND(alt_base_m, 3) AS alt_base_m, ROUND(alt_top_m, 3) AS alt_top_m, ROUND(climb_rate_ms, 4) AS climb_rate_ms,
 ROUND(n_turns, 3) AS n_turns, turn_sign, method"""


def soaring_obs(spark, d):
    return filters.soaring_only(fx.obs(spark, d))


def clean(spark, d):
    return tracks.clean_tracks(soaring_obs(spark, d))


def detected(spark, d):
    return phases.detect_phases(clean(spark, d))


def stored(phases):
    """Phases as the table the statistics read in practice, detected once."""
    return cut_lineage(phases, "phases")


def fix_out(df):
    return rounded(df.select("day", "source_id", "t_s", "lat", "lon", "alt_m"), lat=4, lon=4, alt_m=2)


def phase_out(df):
    return rounded(
        df.select(*phases.PHASE_COLUMNS), lat_centroid=4, lon_centroid=4, alt_mean_m=3, alt_base_m=3,
        alt_top_m=3, climb_rate_ms=4, n_turns=3,
    )


@query("t1_receiver_consensus", fx.with_sql("obs", body=SOARING + CONSENSUS + f"SELECT {FIX_OUT} FROM merged"))
def _t1(spark, d):
    return fix_out(tracks.receiver_consensus(soaring_obs(spark, d)))


@query("t2_spike_reject", fx.with_sql("obs", recursive=True, body=SOARING + CONSENSUS + SPIKES + f"SELECT {FIX_OUT} FROM twice"))
def _t2(spark, d):
    return fix_out(tracks.spike_reject(tracks.receiver_consensus(soaring_obs(spark, d))))


@query(
    "t3_min_fixes",
    fx.with_sql("obs", body=SOARING + CONSENSUS + """, sized AS (SELECT *, COUNT(*) OVER (PARTITION BY day, source_id) AS n FROM merged)
    SELECT day, source_id, COUNT(*) AS n_fixes FROM sized WHERE n >= 60 GROUP BY 1, 2"""),
)
def _t3(spark, d):
    kept = tracks.min_fixes(tracks.receiver_consensus(soaring_obs(spark, d)), 60)
    return kept.groupBy("day", "source_id").agg(F.count("*").alias("n_fixes"))


@query(
    "t4_aircraft_type_first",
    fx.with_sql("obs", body="""SELECT day, source_id, ARG_MIN(aircraft_type, t_s * 10 + rx) AS aircraft_type
    FROM (SELECT * REPLACE (CAST((aircraft_type + t_s // 4) % 9 AS INT) AS aircraft_type) FROM obs) GROUP BY 1, 2"""),
)
def _t4(spark, d):
    packets = fx.obs(spark, d).select(
        "day", "source_id", ((F.col("aircraft_type") + F.floor(F.col("t_s") / 4)) % 9).cast("int").alias("aircraft_type"),
        F.col("t_s").alias("ts_recv"), F.col("rx").cast("string").alias("raw"),
    )
    return tracks.aircraft_type_first(packets)


@query(
    "t5_cap_aircraft",
    fx.with_sql("obs", body=""", chosen AS (SELECT source_id FROM obs GROUP BY 1 ORDER BY MIN(alt_m), MIN(source_id) LIMIT 10)
    SELECT source_id, COUNT(*) AS n_obs FROM obs WHERE source_id IN (SELECT source_id FROM chosen) GROUP BY 1"""),
)
def _t5(spark, d):
    capped = tracks.cap_aircraft(fx.obs(spark, d), 10, ["alt_m"])
    return capped.groupBy("source_id").agg(F.count("*").alias("n_obs"))


@query("t6_assemble_tracks", fx.with_sql("obs", recursive=True, body=TO_CLEAN + f"SELECT {FIX_OUT} FROM clean"))
def _t6(spark, d):
    return fix_out(clean(spark, d))


@query(
    "t7_rolling_turn",
    fx.with_sql("obs", recursive=True, body=TO_CLEAN + BEARINGS + ROLLED + """
    SELECT day, source_id, t_s, ROUND(turn, 3) AS turn, ROUND(turn_sum, 3) AS turn_sum FROM rolled WHERE turn IS NOT NULL"""),
)
def _t7(spark, d):
    turned = phases.rolling_turn(clean(spark, d)).where("turn IS NOT NULL")
    return rounded(turned.select("day", "source_id", "t_s", "turn", "turn_sum"), turn=3, turn_sum=3)


@query(
    "t8_rolling_confined",
    fx.with_sql("obs", recursive=True, body=TO_CLEAN + BEARINGS + ROLLED + "SELECT day, source_id, t_s, confined FROM flagged"),
)
def _t8(spark, d):
    return phases.rolling_confined(clean(spark, d)).select("day", "source_id", "t_s", "confined")


@query(
    "t9_phase_islands",
    fx.with_sql("obs", recursive=True, body=TO_CLEAN + BEARINGS + ROLLED + ISLANDS + """
    SELECT day, source_id, CAST(phase_no AS BIGINT) AS phase_no, t0 AS phase_start_s, t1 AS phase_end_s, COUNT(*) AS n_rows FROM island GROUP BY 1, 2, 3, 4, 5"""),
)
def _t9(spark, d):
    rows = phases.phase_islands(phases.circling_flags(clean(spark, d)))
    keys = ["day", "source_id", "phase_no", "phase_start_s", "phase_end_s"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))


@query(
    "t10_phase_metrics",
    fx.with_sql("obs", recursive=True, body=TO_CLEAN + BEARINGS + ROLLED + ISLANDS + METRICS + """
    SELECT day, source_id, CAST(phase_no AS BIGINT) AS phase_no, duration_s, ROUND(climb_rate_ms, 4) AS climb_rate_ms,
    ROUND(turn_total_deg, 3) AS turn_total_deg, ROUND(spacing_s, 2) AS spacing_s, ROUND(radius_m, 3) AS radius_m FROM metrics"""),
)
def _t10(spark, d):
    m = phases.phase_metrics(phases.phase_islands(phases.circling_flags(clean(spark, d))))
    cols = ["day", "source_id", "phase_no", "duration_s", "climb_rate_ms", "turn_total_deg", "spacing_s", "radius_m"]
    return rounded(m.select(*cols), climb_rate_ms=4, turn_total_deg=3, spacing_s=2, radius_m=3)


@query(
    "t11_phase_classify",
    fx.with_sql("obs", recursive=True, body=TO_PHASE + "SELECT method, turn_sign, COUNT(*) AS n_phases, ROUND(SUM(n_turns), 3) AS turns FROM phase GROUP BY 1, 2"),
)
def _t11(spark, d):
    m = phases.phase_metrics(phases.phase_islands(phases.circling_flags(clean(spark, d))))
    kept = phases.phase_classify(m)
    return kept.groupBy("method", "turn_sign").agg(
        F.count("*").alias("n_phases"), rnd(F.sum("n_turns"), 3).alias("turns")
    )


@query("t12_detect_phases", fx.with_sql("obs", recursive=True, body=TO_PHASE + f"SELECT {PHASE_OUT} FROM phase"))
def _t12(spark, d):
    return phase_out(detected(spark, d))


@query(
    "t14_aircraft_track",
    fx.with_sql("obs", recursive=True, body=TO_CLEAN + f"SELECT {FIX_OUT} FROM clean WHERE day = 0 AND source_id = 8"),
)
def _t14(spark, d):
    return fix_out(tracks.aircraft_track(clean(spark, d), 0, 8))


@query(
    "p9_geo_columns",
    fx.with_sql("obs", body=SOARING + CONSENSUS + f"""
    , clean AS (SELECT * FROM merged) {BEARINGS}
    SELECT day, source_id, t_s, ROUND(2 * {R} * ASIN(LEAST(1.0e0, SQRT(POW(SIN(RADIANS(nlat - lat) / 2), 2) + COS(RADIANS(lat)) * COS(RADIANS(nlat)) * POW(SIN(RADIANS(nlon - lon) / 2), 2)))), 3) AS step_m,
      ROUND(bout, 3) AS bearing_deg, ROUND(turn, 3) AS turn_deg FROM turns"""),
)
def _p9(spark, d):
    order = tracks.track_order()
    ahead = (F.lead("lat").over(order), F.lead("lon").over(order))
    legs = tracks.receiver_consensus(soaring_obs(spark, d)).select(
        "day", "source_id", "t_s",
        haversine_m(F.col("lat"), F.col("lon"), *ahead).alias("step_m"),
        bearing_deg(F.col("lat"), F.col("lon"), *ahead).alias("bearing_deg"),
    )
    turned = legs.withColumn("turn_deg", signed_turn(F.lag("bearing_deg").over(order), F.col("bearing_deg")))
    return rounded(turned, step_m=3, bearing_deg=3, turn_deg=3)
