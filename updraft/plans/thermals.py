"""The day job: beacon log to clean layer to circling phases with regions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updraft.operators import filters, phases, spatial, tracks
from updraft.session import broadcast_if_small, cut_lineage
from updraft.sources import beacons, tables


@dataclass(frozen=True)
class DayTables:
    """Where the job keeps its derived tables."""

    clean: str
    phases: str
    ledger: str


def log_observations(log: DataFrame, hours: tuple[int, int] | None = filters.DAY_HOURS) -> DataFrame:
    """Soaring positions of a typed log, cheap filters before the parser."""
    lines = filters.drop_status_lines(log)
    if hours is not None:
        lines = filters.hour_window(lines, *hours)
    positions = filters.soaring_only(filters.positions_only(beacons.parse_beacons(lines)))
    return beacons.observations(positions)


def cache_clean(observations: DataFrame, path: str) -> None:
    """Builds the clean layer, with short tracks kept for later settings."""
    tables.write_clean_fixes(tracks.clean_tracks(observations, tracks.CLEAN_LAYER_MIN_FIXES), path)


def _present_days(spark, path: str) -> DataFrame | None:
    """Days of a derived table, or None before anything was written to it."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return table.select("day").distinct()


def aircraft_day(log: DataFrame, clean_path: str, day, source_id: str) -> DataFrame:
    """One aircraft's fixes of a day: from the clean layer, else from the raw log.

    Of the log only this aircraft's lines reach the parser.
    """
    spark = log.sparkSession
    present = _present_days(spark, clean_path)
    if present is not None and not present.where(F.col("day") == day).isEmpty():
        return tracks.aircraft_track(tables.read_clean_fixes(spark, clean_path), day, source_id)
    lines = log.where((F.col("day") == day) & (beacons.sender(F.col("raw")) == source_id))
    return tracks.aircraft_track(tracks.clean_tracks(log_observations(lines), tracks.CLEAN_LAYER_MIN_FIXES), day, source_id)


def clean_layer(observations: DataFrame, days: DataFrame, path: str) -> DataFrame:
    """Clean fixes of the days, building only the days the layer lacks."""
    spark = observations.sparkSession
    present = _present_days(spark, path)
    absent = days if present is None else days.join(present, "day", "left_anti")
    if not absent.isEmpty():
        # Shuffled by day, a whole day with all its later windows would be one task.
        cache_clean(observations.join(broadcast_if_small(absent), "day", "left_semi"), path)
    return tables.read_clean_fixes(spark, path).join(broadcast_if_small(days), "day", "left_semi")


def detect_days(
    observations: DataFrame,
    days: DataFrame,
    regions: DataFrame,
    where: DayTables,
    batch: str,
    min_fixes: int = tracks.MIN_FIXES,
) -> DataFrame:
    """Detects, places and stores the phases of all days in one plan."""
    days = cut_lineage(days.select("day").distinct(), "days")  # used several times
    fixes = tracks.min_fixes(clean_layer(observations, days, where.clean), min_fixes)
    found = phases.detect_phases(fixes)
    placed = spatial.assign_region(
        found, regions, "lon_centroid", "lat_centroid", ("terrain_type", "habitat_class")
    )
    tables.write_phases(placed, days, where.phases, where.ledger, batch)
    schema = placed.withColumn("batch", F.lit(batch)).schema
    return tables.read_phases(observations.sparkSession, where.phases, where.ledger, schema)


def reassign_days(where: DayTables, regions: DataFrame, batch: str) -> DataFrame:
    """Replays the region join over every stored day and stores the result.

    The new rows go to a fresh table first: a table cannot replace the one it
    is read from.
    """
    spark = regions.sparkSession
    stored = tables.read_phases(spark, where.phases, where.ledger)
    days = spark.read.parquet(where.ledger).select("day")
    placed = cut_lineage(spatial.reassign_regions(stored, regions), "reassigned")
    tables.write_phases(placed, cut_lineage(days, "days"), where.phases, where.ledger, batch)
    return tables.read_phases(spark, where.phases, where.ledger)


def pending(log_days: DataFrame, where: DayTables, last_n: int | None = None) -> DataFrame:
    """Days with a log that the ledger does not list."""
    from updraft.operators.activity import pending_days

    done = _present_days(log_days.sparkSession, where.ledger)
    if done is None:
        done = log_days.select("day").where(F.lit(False))
    return pending_days(log_days, done, last_n)
