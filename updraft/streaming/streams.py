"""Structured Streaming forms of the live-feed operators.

Landed files come in any order and number, so the drains here keep no watermark:
each batch becomes partial results per key, which merge with those stored so
far (``state``). A packet that comes late changes its own group and none is lost.
Every query takes its checkpoint folder as an argument and restarts from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from updraft.operators.activity import estimates, hourly_sketches, united_sketches, watched_lines
from updraft.operators.health import STATE, job_state
from updraft.operators.tracks import receiver_consensus
from updraft.sources.beacons import LOG_SCHEMA, parse_beacons, receive_time, sender, with_receive_time
from updraft.streaming.state import Merged, merged_rows, run_merged


def beacon_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Landed JSON-lines logs as a stream of all their lines, whole or not."""
    schema = f"{LOG_SCHEMA}, _corrupt_record STRING"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return receive_time(reader.option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def beacon_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Landed JSON-lines logs as a stream of typed rows."""
    reader = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    return with_receive_time(reader.json(path))


def stream_land(packets: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends every packet to the day of its receipt, exactly once.

    A line without a usable time, or that is no JSON, lands without a day.
    """
    writer = packets.writeStream.outputMode("append").format("parquet").partitionBy("day")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- merged drains -----------------------------------------------------------


def _summed(*keys: str, **sums: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def health_state(tick_s: int = 240) -> Merged:
    """Packets per keep-alive window; the bucket is the window's day."""
    tick = F.floor(F.unix_timestamp("ts_recv") / tick_s).alias("tick")
    day = f"to_date(timestamp_seconds(tick * {tick_s}))"
    return Merged(lambda batch: batch.groupBy(tick).agg(F.count("*").alias("packets")), _summed("tick", packets="packets"), day)


def run_health(packets: DataFrame, path: str, checkpoint: str, tick_s: int = 240) -> None:
    """Packets per keep-alive window."""
    run_merged(packets, path, checkpoint, health_state(tick_s))


def stream_health(spark: SparkSession, path: str, ticks: DataFrame, tick_s: int = 240) -> DataFrame:
    """Every window of ``ticks`` (column ``ts_recv``) or with packets, ``ok`` or ``fail``."""
    wanted = ticks.select(F.floor(F.unix_timestamp("ts_recv") / tick_s).alias("tick")).distinct()
    found = merged_rows(spark, path, health_state(tick_s), "tick LONG, packets LONG")
    full = wanted.join(found, "tick", "full").withColumn("packets", F.coalesce("packets", F.lit(0)))
    return full.select(
        F.timestamp_seconds(F.col("tick") * tick_s).alias("tick_start"),
        "packets",
        F.when(F.col("packets") > 0, "ok").otherwise("fail").alias("status"),
    )


_POSITION = ("lat", "lon", "alt_m", "climb_ms", "speed_kmh", "course_deg")


def position_state(watchlist: DataFrame | None = None) -> Merged:
    """Packets and last position of each watched aircraft, in one bucket: the watch list bounds it."""

    def partial(batch: DataFrame) -> DataFrame:
        seen = parse_beacons(watched_lines(batch, watchlist)).groupBy("source_id")
        last = F.max(F.when(F.col("kind") == "position", F.struct("ts_recv", "raw", *_POSITION)))
        return seen.agg(F.count("*").alias("packets"), last.alias("last"))

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("source_id").agg(F.sum("packets").alias("packets"), F.max("last").alias("last"))

    return Merged(partial, merge, "'all'")


def run_last_position(packets: DataFrame, watchlist: DataFrame, path: str, checkpoint: str) -> None:
    """Last position and packets of each watched aircraft; only their lines are parsed."""
    run_merged(packets, path, checkpoint, position_state(watchlist))


def stream_last_position(spark: SparkSession, path: str) -> DataFrame:
    """Current position per watched aircraft."""
    fields = "ts_recv: TIMESTAMP, raw: STRING, " + ", ".join(f"{c}: DOUBLE" for c in _POSITION)
    found = merged_rows(spark, path, position_state(), f"source_id STRING, packets LONG, last STRUCT<{fields}>")
    return found.select(
        "source_id", "packets", F.col("last.ts_recv").alias("last_seen"), *[F.col(f"last.{c}").alias(c) for c in _POSITION]
    )


def _heard(batch: DataFrame) -> DataFrame:
    return batch.select(F.to_date("ts_recv").alias("day"), F.hour("ts_recv").alias("hour"), sender(F.col("raw")).alias("_id"))


#: Packets per hour and sender: exact, and as many rows as senders.
ACTIVITY_STATE = Merged(
    lambda batch: _heard(batch).groupBy("day", "hour", "_id").agg(F.count("*").alias("n")),
    _summed("day", "hour", "_id", n="n"),
    "day",
)


def run_hourly_activity(packets: DataFrame, path: str, checkpoint: str) -> None:
    """Packets per hour and sender; no set of ids is built."""
    run_merged(packets, path, checkpoint, ACTIVITY_STATE)


def stream_hourly_activity(spark: SparkSession, path: str) -> DataFrame:
    """Exact distinct senders and packets per hour."""
    per_hour = merged_rows(spark, path, ACTIVITY_STATE, "day DATE, hour INT, _id STRING, n LONG").groupBy("day", "hour")
    return per_hour.agg(F.count("_id").alias("n_aircraft"), F.sum("n").alias("n_packets"))


#: One row per hour whatever the traffic: packets, and a sketch of the senders that can be united.
SKETCH_STATE = Merged(
    lambda batch: hourly_sketches(_heard(batch)),
    lambda rows: united_sketches(rows, "day", "hour"),
    "day",
)


def run_hourly_sketches(packets: DataFrame, path: str, checkpoint: str) -> None:
    """As :func:`run_hourly_activity` without a row per sender."""
    run_merged(packets, path, checkpoint, SKETCH_STATE)


def stream_activity_estimate(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Estimated senders and exact packets per hour, or per coarser ``keys`` such as the day."""
    found = merged_rows(spark, path, SKETCH_STATE, "day DATE, hour INT, senders BINARY, n_packets LONG")
    return estimates(united_sketches(found, *(keys or ("day", "hour"))))


# -- landed drains -----------------------------------------------------------


def run_consensus(observations: DataFrame, path: str, checkpoint: str) -> None:
    """Lands observations by day; a median needs all receivers of its second."""
    stream_land(observations, path, checkpoint).awaitTermination()


def stream_consensus(spark: SparkSession, path: str) -> DataFrame:
    """Receiver median per aircraft and GPS second of what has landed so far."""
    return receiver_consensus(spark.read.parquet(path))


def run_append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drains the available input into a parquet table."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_job_state(attempts: DataFrame, path: str, checkpoint: str) -> None:
    """Lands the attempts, in any order."""
    run_append(attempts, path, checkpoint)


def current_job_state(spark: SparkSession, path: str) -> DataFrame:
    """State by all attempts landed so far: a late one can still split a streak."""
    return job_state(spark.read.parquet(path)).select(*STATE)
