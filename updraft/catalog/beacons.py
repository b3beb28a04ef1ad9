"""Beacon log, activity and watch-list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from updraft import fixtures as fx
from updraft.catalog.registry import query, rnd, rounded
from updraft.catalog.spatial import phases_with_region
from updraft.catalog.tracks import TO_CLEAN, TO_CLEAN_TYPED, TO_PHASE, TO_PHASE_TYPED, clean, detected, stored
from updraft.operators import activity, filters, health, phases, tracks
from updraft.sources import beacons, tables

NUMBERS = "ROUND(lat, 6) AS lat, ROUND(lon, 6) AS lon, ROUND(alt_m, 3) AS alt_m, ROUND(climb_ms, 4) AS climb_ms, ROUND(speed_kmh, 3) AS speed_kmh, course_deg"
DIGITS = dict(lat=6, lon=6, alt_m=3, climb_ms=4, speed_kmh=3)


def log(spark, d):
    return beacons.with_receive_time(fx.raw_line(spark, d))


def parsed(spark, d):
    return beacons.parse_beacons(log(spark, d))


@query(
    "s3_parse_beacons",
    fx.with_sql("beacon", body=f"SELECT day, source_id, kind, aircraft_type, ts_recv, CAST(HOUR(packet) AS INT) AS packet_h, CAST(MINUTE(packet) AS INT) AS packet_m, CAST(SECOND(packet) AS INT) AS packet_s, {NUMBERS} FROM beacon"),
)
def _s3(spark, d):
    return rounded(parsed(spark, d).drop("raw"), **DIGITS)


@query("p1_drop_status_lines", fx.with_sql("beacon", body="SELECT day, COUNT(*) AS n FROM beacon WHERE kind <> 'other' GROUP BY 1"))
def _p1(spark, d):
    return filters.drop_status_lines(log(spark, d)).groupBy("day").agg(F.count("*").alias("n"))


@query("p2_hour_window", fx.with_sql("beacon", body="SELECT day, COUNT(*) AS n FROM beacon WHERE HOUR(ts_recv) BETWEEN 7 AND 18 GROUP BY 1"))
def _p2(spark, d):
    return filters.hour_window(log(spark, d)).groupBy("day").agg(F.count("*").alias("n"))


@query("p3_soaring_positions", fx.with_sql("beacon", body="SELECT source_id, aircraft_type, COUNT(*) AS n FROM beacon WHERE kind = 'position' AND alt_m IS NOT NULL AND aircraft_type IN (1, 6, 7) GROUP BY 1, 2"))
def _p3(spark, d):
    kept = filters.soaring_only(filters.positions_only(parsed(spark, d)))
    return kept.groupBy("source_id", "aircraft_type").agg(F.count("*").alias("n"))


GPS = "COALESCE(CAST(CAST(ts_recv AS DATE) AS TIMESTAMP) + (DATE_TRUNC('second', packet) - DATE_TRUNC('day', packet)), DATE_TRUNC('second', ts_recv))"


@query("p4_gps_timestamp", fx.with_sql("beacon", body=f"SELECT source_id, ts_recv, {GPS} AS gps_ts FROM beacon WHERE kind = 'position'"))
def _p4(spark, d):
    rows = parsed(spark, d).where("kind = 'position'")
    return beacons.gps_timestamp(rows).select("source_id", "ts_recv", "gps_ts")


@query(
    "p4_gps_timestamp_midnight",
    fx.with_sql("beacon", body="SELECT source_id, ts_recv, COALESCE(DATE_TRUNC('second', packet), DATE_TRUNC('second', ts_recv)) AS gps_ts FROM beacon WHERE kind = 'position'"),
)
def _p4_midnight(spark, d):
    rows = parsed(spark, d).where("kind = 'position'")
    return beacons.gps_timestamp(rows, midnight_fix=True).select("source_id", "ts_recv", "gps_ts")


@query(
    "p5_aircraft_label",
    fx.with_sql("beacon", body="SELECT CASE aircraft_type WHEN 1 THEN 'glider' WHEN 6 THEN 'hangglider' WHEN 7 THEN 'paraglider' ELSE 'unknown' END AS label, COUNT(*) AS n FROM beacon GROUP BY 1"),
)
def _p5(spark, d):
    label = filters.aircraft_label(F.col("aircraft_type")).alias("label")
    return parsed(spark, d).groupBy(label).agg(F.count("*").alias("n"))


@query("p6_min_climb", fx.with_sql("obs", recursive=True, body=TO_PHASE + "SELECT source_id, t_start_s FROM phase WHERE climb_rate_ms >= 1.2e0"))
def _p6(spark, d):
    return filters.min_climb(detected(spark, d), 1.2).select("source_id", "t_start_s")


@query(
    "t1_consensus_from_log",
    fx.with_sql("beacon", body=f"""
    , ok AS (SELECT *, EPOCH({GPS}) AS t FROM beacon WHERE kind = 'position' AND alt_m IS NOT NULL AND aircraft_type IN (1, 6, 7) AND HOUR(ts_recv) BETWEEN 7 AND 18)
    SELECT day, source_id, CAST(t AS BIGINT) AS t_s, MIN(aircraft_type) AS aircraft_type, ROUND(MEDIAN(lat), 6) AS lat, ROUND(MEDIAN(lon), 6) AS lon, ROUND(MEDIAN(alt_m), 3) AS alt_m FROM ok GROUP BY 1, 2, 3"""),
)
def _t1_log(spark, d):
    from updraft.plans.thermals import log_observations

    return rounded(tracks.receiver_consensus(log_observations(log(spark, d))), lat=6, lon=6, alt_m=3)


def obs_log(spark, d):
    """The observations, written as gz lines and read back."""
    path = _scratch(spark, "log")
    fx.obs_line(spark, d).write.option("compression", "gzip").json(path)
    return beacons.read_beacon_log(spark, path)


LINE_OUT = "day, source_id, t_s, aircraft_type, ROUND(lat, 5) AS lat, ROUND(lon, 5) AS lon, ROUND(alt_m, 2) AS alt_m"
IN_REGION = "LEFT JOIN region_box ON lon_centroid >= x0 AND lon_centroid < x1 AND lat_centroid >= y0 AND lat_centroid < y1"


@query("t6_assemble_from_log", fx.with_sql("obs_line", recursive=True, body=TO_CLEAN_TYPED + f"SELECT {LINE_OUT} FROM clean"))
def _t6_log(spark, d):
    from updraft.plans.thermals import log_observations

    return rounded(tracks.clean_tracks(log_observations(obs_log(spark, d))), lat=5, lon=5, alt_m=2)


@query(
    "flagship_from_log",
    fx.with_sql("obs_line", "region_box", recursive=True, body=TO_PHASE_TYPED + f"""SELECT source_id, aircraft_type, t_start_s, duration_s, ROUND(climb_rate_ms, 3) AS climb_rate_ms, turn_sign, method, region_id FROM phase {IN_REGION}"""),
)
def _flagship_log(spark, d):
    """Raw lines to stored phases with their region, in one go."""
    from updraft.plans.thermals import DayTables, detect_days, log_observations

    log = obs_log(spark, d)
    base = _scratch(spark, "day")
    where = DayTables(f"{base}/clean", f"{base}/phases", f"{base}/ledger")
    days = log.select("day").distinct()
    written = detect_days(log_observations(log), days, fx.region(spark, d), where, "run-1")
    out = written.select("source_id", "aircraft_type", "t_start_s", "duration_s", "climb_rate_ms", "turn_sign", "method", "region_id")
    return rounded(out, climb_rate_ms=3)


@query("t14_track_from_either", fx.with_sql("obs_line", recursive=True, body=TO_CLEAN_TYPED + """, kept AS (SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY day, source_id) AS m FROM twice) WHERE m >= 5)
    SELECT layer, source_id, t_s, aircraft_type FROM kept CROSS JOIN (VALUES ('clean'), ('raw')) v(layer) WHERE source_id = PRINTF('FLR%06X', 8)"""))
def _t14_either(spark, d):
    """One aircraft's day from the clean layer, and from the raw log before that layer exists."""
    import datetime as dt

    from updraft.plans.thermals import aircraft_day, cache_clean, log_observations

    log, path = obs_log(spark, d), _scratch(spark, "clean")
    wanted = (dt.date(2024, 6, 1), "FLR000008")
    raw = aircraft_day(log, path, *wanted)
    cache_clean(log_observations(log), path)
    stored_day = aircraft_day(log, path, *wanted)
    both = raw.withColumn("layer", F.lit("raw")).unionByName(stored_day.withColumn("layer", F.lit("clean")))
    return both.select("layer", "source_id", "t_s", "aircraft_type")


ACTIVITY = """
, act AS (SELECT d.day, CAST(h AS INT) AS hour, COUNT(DISTINCT source_id) AS n_aircraft, COUNT(event_id) AS n_packets FROM (SELECT DISTINCT day FROM beacon) d CROSS JOIN range(0, 24) r(h)
    LEFT JOIN beacon b ON b.day = d.day AND HOUR(b.ts_recv) = h GROUP BY 1, 2)"""


@query("a1_hourly_activity", fx.with_sql("beacon", body=ACTIVITY + "SELECT * FROM act"))
def _a1(spark, d):
    return activity.hourly_activity(log(spark, d))


@query(
    "a2_peak_hour",
    fx.with_sql("beacon", body=ACTIVITY + "SELECT day, CAST(SUM(n_packets) AS BIGINT) AS n_packets, ARG_MAX(hour, (n_aircraft, -hour)) AS peak_hour FROM act GROUP BY 1"),
)
def _a2(spark, d):
    return activity.peak_hour(activity.hourly_activity(log(spark, d)))


@query(
    "j8_watchlist_positions",
    fx.with_sql("beacon", "watchlist", body="""
    , n AS (SELECT source_id, COUNT(*) AS packets FROM beacon GROUP BY 1)
    , p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY ts_recv DESC, event_id DESC) AS rn FROM beacon WHERE kind = 'position')
    SELECT w.source_id, w.name, COALESCE(packets, 0) AS packets, ts_recv AS last_seen, ROUND(lat, 6) AS lat, ROUND(lon, 6) AS lon, ROUND(alt_m, 3) AS alt_m, ROUND(climb_ms, 4) AS climb_ms,
      ROUND(speed_kmh, 3) AS speed_kmh, course_deg, aircraft_type FROM watchlist w LEFT JOIN n ON n.source_id = w.source_id LEFT JOIN p ON p.source_id = w.source_id AND rn = 1"""),
)
def _j8(spark, d):
    return rounded(activity.watchlist_positions(log(spark, d), fx.watchlist(spark, d)), **DIGITS)


@query(
    "b4_active_flag",
    fx.with_sql("beacon", "watchlist", body="""
    , p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY ts_recv DESC, event_id DESC) AS rn FROM beacon WHERE kind = 'position')
    SELECT w.source_id, CAST(EPOCH(DATE_TRUNC('second', ts_recv)) AS BIGINT) AS seen_s, COALESCE(1706659200 - CAST(EPOCH(DATE_TRUNC('second', ts_recv)) AS BIGINT) < 43200, FALSE) AS is_active
    FROM watchlist w LEFT JOIN p ON p.source_id = w.source_id AND rn = 1 WHERE lat IS NOT NULL"""),
)
def _b4(spark, d):
    positions = activity.watchlist_positions(log(spark, d), fx.watchlist(spark, d))
    flagged = health.active_flag(positions, F.to_timestamp(F.lit("2024-01-31 00:00:00")), 720)
    return health.located(flagged).select("source_id", F.unix_timestamp("last_seen").alias("seen_s"), "is_active")


@query(
    "a12_job_window_status",
    fx.with_sql("beacon", body="""
    , c AS (SELECT CAST(FLOOR(EPOCH(ts_recv) / 240) AS BIGINT) AS tick, COUNT(*) AS n FROM beacon GROUP BY 1)
    , s AS (SELECT UNNEST(GENERATE_SERIES((SELECT MIN(tick) FROM c), (SELECT MAX(tick) FROM c))) AS tick)
    SELECT CAST(MAKE_TIMESTAMP(s.tick * 240000000) AS TIMESTAMP) AS tick_start, COALESCE(n, 0) AS packets, CAST(SUM(COALESCE(n, 0)) OVER (ORDER BY s.tick) AS BIGINT) AS total_packets,
      CASE WHEN COALESCE(n, 0) > 0 THEN 'ok' ELSE 'fail' END AS status FROM s LEFT JOIN c ON c.tick = s.tick"""),
)
def _a12(spark, d):
    return health.job_window_status(log(spark, d))


@query(
    "j16_overlay_phases_on_track",
    fx.with_sql("obs", recursive=True, body=TO_PHASE + """SELECT c.source_id, c.t_s, p.t_start_s AS phase_start_s FROM clean c
    LEFT JOIN phase p ON p.day = c.day AND p.source_id = c.source_id AND c.t_s BETWEEN p.t_start_s AND p.t_end_s"""),
)
def _j16(spark, d):
    fixes = stored(clean(spark, d))  # as the clean layer is: both sides read it
    out = activity.overlay_phases_on_track(fixes, phases.detect_phases(fixes))
    return out.select("source_id", "t_s", "phase_start_s")


STATS = "COUNT(*) AS n, ROUND(MEDIAN({c}), 3) AS climb_median_ms, ROUND(QUANTILE_CONT({c}, 0.9), 3) AS climb_q90_ms, ROUND(MEDIAN(alt_top_m), 2) AS top_median_m"


@query("a3_phase_summary", fx.with_sql("obs", recursive=True, body=TO_PHASE + f"SELECT {STATS.format(c='climb_rate_ms')}, ROUND(MAX(alt_top_m), 2) AS top_max_m FROM phase"))
def _a3(spark, d):
    out = activity.phase_summary(stored(detected(spark, d)))
    return rounded(out, climb_median_ms=3, climb_q90_ms=3, top_median_m=2, top_max_m=2)


@query(
    "a4_phase_stats_by_type",
    fx.with_sql("obs", recursive=True, body=TO_PHASE + f"""SELECT CASE WHEN source_id % 3 = 0 THEN NULL ELSE aircraft_type END AS aircraft_type,
    {STATS.format(c='CASE WHEN climb_rate_ms > 0 THEN climb_rate_ms END')} FROM phase GROUP BY 1"""),
)
def _a4(spark, d):
    kind = F.when(F.col("source_id") % 3 != 0, F.col("aircraft_type"))
    out = activity.phase_stats_by_type(stored(detected(spark, d)).withColumn("aircraft_type", kind))
    return rounded(out, climb_median_ms=3, climb_q90_ms=3, top_median_m=2)


# -- tables ------------------------------------------------------------------


def _scratch(spark, label):
    from updraft.session import scratch_path

    return scratch_path(spark, label)


LOG_COUNTS = fx.with_sql("beacon", body="SELECT day, COUNT(*) AS n, COUNT(DISTINCT source_id) AS n_senders FROM beacon GROUP BY 1")


def log_counts(df):
    return df.groupBy("day").agg(F.count("*").alias("n"), F.count_distinct(beacons.sender(F.col("raw"))).alias("n_senders"))


@query("s1_read_beacon_log", LOG_COUNTS)
def _s1(spark, d):
    path = _scratch(spark, "log")
    fx.raw_line(spark, d).write.option("compression", "gzip").json(path)
    return log_counts(beacons.read_beacon_log(spark, path))


@query("s2_compact_beacon_log", LOG_COUNTS)
def _s2(spark, d):
    path = _scratch(spark, "compact")
    beacons.compact_beacon_log(log(spark, d), path)
    return log_counts(beacons.read_compacted(spark, path))


@query("s4_clean_fixes_table", fx.with_sql("obs", recursive=True, body=TO_CLEAN + "SELECT day, source_id, COUNT(*) AS n, ROUND(SUM(alt_m), 2) AS alt_sum FROM clean GROUP BY 1, 2"))
def _s4(spark, d):
    path = _scratch(spark, "clean")
    tables.write_clean_fixes(clean(spark, d), path)
    back = tables.read_clean_fixes(spark, path)
    return back.groupBy(F.col("day").cast("long").alias("day"), "source_id").agg(F.count("*").alias("n"), rnd(F.sum("alt_m"), 2).alias("alt_sum"))


@query(
    "s5_write_phases",
    fx.with_sql("obs", recursive=True, body=TO_PHASE + """SELECT d.day, COUNT(p.day) AS n_phases FROM (SELECT DISTINCT day FROM obs UNION SELECT MAX(day) + 1 FROM obs) d LEFT JOIN phase p ON p.day = d.day GROUP BY 1"""),
)
def _s5(spark, d):
    path, ledger = _scratch(spark, "phases"), _scratch(spark, "ledger")
    days = fx.obs(spark, d).select("day").distinct()
    silent = days.agg((F.max("day") + 1).alias("day"))
    tables.write_phases(detected(spark, d), days.unionByName(silent), path, ledger, "first")
    return spark.read.parquet(ledger).select(F.col("day").cast("long").alias("day"), "n_phases")


@query("s6_upsert_grid", fx.with_sql("grid_cell", body="SELECT init_h, var, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM grid_cell GROUP BY 1, 2"))
def _s6(spark, d):
    path = _scratch(spark, "grid")
    grid = fx.grid_cell(spark, d)
    tables.upsert_grid(grid, path)
    tables.upsert_grid(grid.where("init_h = 3"), path)
    return spark.read.parquet(path).groupBy("init_h", "var").agg(F.count("*").alias("n"), rnd(F.sum("value"), 2).alias("total"))


@query(
    "s7_manifest_round_trip",
    fx.with_sql("manifest", body="SELECT tier, COUNT(*) AS n, CAST(SUM(bytes_on_disk) AS BIGINT) AS bytes, CAST(SUM(CASE WHEN tier = 'tier2_decision' AND fire THEN 1 ELSE 0 END) AS BIGINT) AS fired FROM manifest GROUP BY 1"),
)
def _s7(spark, d):
    from updraft.catalog.health import nested_manifest

    path = _scratch(spark, "manifest")
    records = nested_manifest(spark, d)
    tables.append_manifest(records.where("tier = 'tier1'"), path)
    tables.append_manifest(records.where("tier <> 'tier1'"), path)
    fired = F.sum((F.coalesce("trigger.fire", F.lit(False)) & (F.col("tier") == "tier2_decision")).cast("long"))
    return tables.read_manifest(spark, path).groupBy("tier").agg(
        F.count("*").alias("n"), F.sum("bytes_on_disk").alias("bytes"), fired.alias("fired")
    )


@query(
    "s10_read_watchlist",
    "SELECT c_name AS name, PRINTF('FLR%06X', c_custkey) AS ogn_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS note FROM customer WHERE c_custkey % 7 <> 0",
)
def _s10(spark, d):
    path = _scratch(spark, "watchlist")
    key = F.col("c_custkey")
    entries = fx.table(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.when(key % 7 != 0, F.format_string("FLR%06X", key)).alias("ogn_name"),
        F.when(key % 3 == 0, F.col("c_mktsegment")).alias("note"),
    )
    entries.write.json(path)
    return tables.read_watchlist(spark, path, multi_line=False)


@query("s11_read_sounding_csv", "SELECT CAST(p_partkey AS BIGINT) AS sample_id, p_brand AS source, ROUND(p_retailprice, 2) AS height_m FROM part")
def _s11(spark, d):
    path = _scratch(spark, "csv")
    part = fx.table(spark, d, "part")
    rows = part.select(F.concat_ws(",", F.col("p_partkey").cast("string"), "p_brand", F.col("p_retailprice").cast("string")).alias("value"))
    # Every file begins with its own comment and header, as the originals do.
    head = F.array(F.lit("# a comment, with commas"), F.lit("sample_id,source,height_m"))
    files = rows.withColumn("file", F.crc32(F.col("value").cast("binary")) % 4).repartition(4, "file")
    begin = spark.range(4).select(F.col("id").alias("file"), F.posexplode(head).alias("at", "value"))
    lines = files.select("file", F.lit(2).alias("at"), "value").unionByName(begin.select("file", F.col("at"), "value"))
    lines.repartition("file").sortWithinPartitions("file", "at").select("file", "value").write.partitionBy("file").text(path)
    table = tables.read_sounding_csv(spark, path, "sample_id BIGINT, source STRING, height_m DOUBLE").drop("file")
    return rounded(table, height_m=2)


@query("s12_write_series", fx.with_sql("grid_cell", "flux", body="SELECT region_id, init_h, COUNT(*) AS n, 'radiation' AS flux_source FROM flux GROUP BY 1, 2"))
def _s12(spark, d):
    path = _scratch(spark, "series")
    tables.write_series(fx.flux(spark, d), path, {"flux_source": "radiation", "model": "bulk"})
    return spark.read.parquet(path).groupBy("region_id", "init_h", "flux_source").agg(F.count("*").alias("n"))


BODY_LENGTHS = "SELECT STRFTIME(CAST(o_orderdate AS DATE), '%Y-%m') AS layer, CAST(SUM(LENGTH(o_orderstatus) + 1) AS BIGINT) AS bytes FROM orders GROUP BY 1"


def _month_files(spark, d):
    """One text file per month: a line of the status for each order."""
    path = _scratch(spark, "inventory")
    rows = fx.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus")
    rows.repartition("month").write.partitionBy("month").text(path)
    return tables.file_inventory(spark, path, r"month=(\d{4}-\d{2})/")


@query("s13_file_inventory", BODY_LENGTHS)
def _s13(spark, d):
    return _month_files(spark, d).select("layer", "bytes")


@query("s13_last_bytes", f"SELECT COUNT(*) AS n_layers, CAST(SUM(bytes) AS BIGINT) AS bytes FROM (SELECT * FROM ({BODY_LENGTHS}) ORDER BY layer DESC LIMIT 7)")
def _s13_last(spark, d):
    return tables.last_bytes(_month_files(spark, d))


@query(
    "s14_best_region_layer",
    "SELECT n_nationkey AS region_id, n_name AS name FROM nation",
)
def _s14(spark, d):
    fine = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("region_id"), F.col("n_name").alias("name"), F.lit(1).alias("priority"))
    coarse = fx.table(spark, d, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("name"), F.lit(2).alias("priority"))
    return tables.best_region_layer(fine.unionByName(coarse))


@query("l3_newest_day", fx.with_sql("beacon", body="SELECT day, source_id, COUNT(*) AS n FROM beacon WHERE day = (SELECT MAX(day) FROM beacon) AND source_id IS NOT NULL GROUP BY 1, 2"))
def _l3(spark, d):
    import datetime as dt

    newest = tables.newest_day(parsed(spark, d), dt.date(2030, 1, 1)).where("source_id IS NOT NULL")
    return newest.groupBy("day", "source_id").agg(F.count("*").alias("n"))


@query(
    "s9_read_regions",
    fx.with_sql("region_box", body="SELECT CAST(region_id AS VARCHAR) AS region_id, name, '' AS terrain_type, 5 AS n_points, x0 AS lon, y0 AS lat FROM region_box"),
)
def _s9(spark, d):
    from updraft.sources import regions

    path = _scratch(spark, "geojson")
    regions.to_geojson(fx.region(spark, d), ("name",)).write.text(path)
    back = regions.read_regions(spark, path, columns=("name", "terrain_type"), multi_line=False)
    first = F.col("rings")[0]
    return back.select(
        "region_id", "name", "terrain_type", F.size(first).alias("n_points"), first[0]["lon"].alias("lon"), first[0]["lat"].alias("lat")
    )


@query("t13_detect_day", fx.with_sql("obs", "region_box", recursive=True, body=TO_PHASE + """SELECT source_id, t_start_s, region_id FROM phase
    LEFT JOIN region_box ON lon_centroid >= x0 AND lon_centroid < x1 AND lat_centroid >= y0 AND lat_centroid < y1"""))
def _t13(spark, d):
    from updraft.plans.thermals import DayTables, detect_days

    base = _scratch(spark, "day")
    where = DayTables(f"{base}/clean", f"{base}/phases", f"{base}/ledger")
    days = fx.obs(spark, d).select("day").distinct()
    written = detect_days(filters.soaring_only(fx.obs(spark, d)), days, fx.region(spark, d), where, "run-1")
    return written.select("source_id", "t_start_s", "region_id")


@query("e0_phases_with_region", fx.with_sql("obs", "region_box", recursive=True, body=TO_PHASE + """SELECT region_id, COUNT(*) AS n FROM phase
    LEFT JOIN region_box ON lon_centroid >= x0 AND lon_centroid < x1 AND lat_centroid >= y0 AND lat_centroid < y1 GROUP BY 1"""))
def _e0(spark, d):
    return phases_with_region(spark, d).groupBy("region_id").agg(F.count("*").alias("n"))
