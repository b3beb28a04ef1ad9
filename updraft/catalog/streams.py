"""Streaming queries, each drained into a table and checked against its batch form.

The feed lies in several files whose rows are shuffled, and one file is read per
batch: the answer must not depend on their number or order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from updraft import fixtures as fx
from updraft.catalog.beacons import ACTIVITY, GPS, LOG_COUNTS, log_counts
from updraft.catalog.health import STATE
from updraft.catalog.registry import query, rounded
from updraft.operators import filters
from updraft.session import scratch_path
from updraft.sources import beacons
from updraft.streaming import streams

FILES = 8


def shuffled(df):
    """``df`` in FILES parts without any order."""
    return df.repartition(FILES, F.xxhash64(*df.columns))


def landed(spark, d) -> str:
    """The radio lines as JSON files."""
    path = scratch_path(spark, "feed")
    shuffled(fx.raw_line(spark, d)).write.json(path)
    return path


def out(spark, label):
    base = scratch_path(spark, label)
    return f"{base}/table", f"{base}/checkpoint"


@query("x1_stream_land", LOG_COUNTS)
def _x1(spark, d):
    table, checkpoint = out(spark, "land")
    lines = streams.beacon_lines(spark, landed(spark, d), 1)
    streams.stream_land(lines, table, checkpoint).awaitTermination()
    return log_counts(spark.read.parquet(table))


@query(
    "x2_stream_health",
    fx.with_sql("beacon", body="""
    , c AS (SELECT CAST(FLOOR(EPOCH(ts_recv) / 240) AS BIGINT) AS tick, COUNT(*) AS n FROM beacon GROUP BY 1)
    , s AS (SELECT UNNEST(GENERATE_SERIES((SELECT MIN(tick) FROM c), (SELECT MAX(tick) FROM c))) AS tick)
    SELECT MAKE_TIMESTAMP(s.tick * 240000000) AS tick_start, COALESCE(n, 0) AS packets, CASE WHEN COALESCE(n, 0) > 0 THEN 'ok' ELSE 'fail' END AS status FROM s LEFT JOIN c ON c.tick = s.tick"""),
)
def _x2(spark, d):
    table, checkpoint = out(spark, "health")
    streams.run_health(streams.beacon_stream(spark, landed(spark, d), 1), table, checkpoint)
    span = fx.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    tick = lambda c: F.floor(F.unix_timestamp(c) / 240)
    bounds = span.agg(F.min(tick("ts")).alias("a"), F.max(tick("ts")).alias("b"))
    ticks = bounds.select(F.explode(F.sequence("a", "b")).alias("t"))
    return streams.stream_health(spark, table, ticks.select(F.timestamp_seconds(F.col("t") * 240).alias("ts_recv")))


@query(
    "x3_stream_last_position",
    fx.with_sql("beacon", "watchlist", body="""
    , n AS (SELECT source_id, COUNT(*) AS packets FROM beacon GROUP BY 1)
    , p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY ts_recv DESC, event_id DESC) AS rn FROM beacon WHERE kind = 'position')
    SELECT n.source_id, packets, ts_recv AS last_seen, ROUND(lat, 6) AS lat, ROUND(lon, 6) AS lon, ROUND(alt_m, 3) AS alt_m, ROUND(climb_ms, 4) AS climb_ms, ROUND(speed_kmh, 3) AS speed_kmh, course_deg
    FROM n JOIN watchlist w ON w.source_id = n.source_id LEFT JOIN p ON p.source_id = n.source_id AND rn = 1"""),
)
def _x3(spark, d):
    table, checkpoint = out(spark, "positions")
    packets = streams.beacon_stream(spark, landed(spark, d), 1)
    streams.run_last_position(packets, fx.watchlist(spark, d), table, checkpoint)
    return rounded(streams.stream_last_position(spark, table), lat=6, lon=6, alt_m=3, climb_ms=4, speed_kmh=3)


@query(
    "x4_stream_consensus",
    fx.with_sql("beacon", body=f"""
    , ok AS (SELECT *, EPOCH({GPS}) AS t FROM beacon WHERE kind = 'position' AND alt_m IS NOT NULL AND aircraft_type IN (1, 6, 7))
    SELECT source_id, CAST(t AS BIGINT) AS t_s, MIN(aircraft_type) AS aircraft_type, ROUND(MEDIAN(lat), 6) AS lat, ROUND(MEDIAN(lon), 6) AS lon, ROUND(MEDIAN(alt_m), 3) AS alt_m FROM ok GROUP BY 1, 2"""),
)
def _x4(spark, d):
    table, checkpoint = out(spark, "consensus")
    parsed = beacons.parse_beacons(streams.beacon_stream(spark, landed(spark, d), 1))
    rows = beacons.observations(filters.soaring_only(filters.positions_only(parsed)))
    streams.run_consensus(rows, table, checkpoint)
    return rounded(streams.stream_consensus(spark, table).drop("day"), lat=6, lon=6, alt_m=3)


@query("x5_stream_hourly_activity", fx.with_sql("beacon", body=ACTIVITY + "SELECT * FROM act WHERE n_packets > 0"))
def _x5(spark, d):
    table, checkpoint = out(spark, "activity")
    streams.run_hourly_activity(streams.beacon_stream(spark, landed(spark, d), 1), table, checkpoint)
    return streams.stream_hourly_activity(spark, table)


@query(
    "x5_stream_activity_estimate",
    fx.with_sql("beacon", body="""SELECT CAST(day AS DATE) AS day, COUNT(*) AS n_packets, TRUE AS within_bound FROM beacon GROUP BY 1"""),
)
def _x5_estimate(spark, d):
    """Days from the sketches of hours; the bound is four standard errors."""
    table, checkpoint = out(spark, "sketches")
    lines = landed(spark, d)
    streams.run_hourly_sketches(streams.beacon_stream(spark, lines, 1), table, checkpoint)
    found = streams.stream_activity_estimate(spark, table, "day")
    heard = streams.with_receive_time(spark.read.schema(streams.LOG_SCHEMA).json(lines))
    exact = heard.groupBy(F.to_date("ts_recv").alias("day")).agg(F.countDistinct(beacons.sender(F.col("raw"))).alias("n"))
    off = F.abs(F.col("n_aircraft") - F.col("n")) <= F.col("n") * 4 * 1.04 / 2**6
    return found.join(exact, "day").select("day", "n_packets", off.alias("within_bound"))


@query("x6_stream_job_state", fx.with_sql("job_attempt", body=STATE + "SELECT * FROM state"))
def _x6(spark, d):
    table, checkpoint = out(spark, "state")
    attempts = fx.job_attempt(spark, d)
    path = scratch_path(spark, "attempts")
    shuffled(attempts).write.parquet(path)
    stream = spark.readStream.schema(attempts.schema).option("maxFilesPerTrigger", 1).parquet(path)
    streams.run_job_state(stream, table, checkpoint)
    return streams.current_job_state(spark, table)
