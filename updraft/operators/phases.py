"""Circling phases of clean tracks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from updraft.functions.geo import EARTH_RADIUS_M, bearing_deg, signed_turn
from updraft.operators.tracks import TRACK, track_order, whole_track


@dataclass(frozen=True)
class PhaseSettings:
    """Thresholds of the detector (fixed values of the method)."""

    turn_window_s: int = 25
    turn_min_deg: float = 180.0
    confine_window_s: int = 120
    confine_radius_m: float = 400.0
    confine_min_fixes: int = 6
    confine_min_gain_m: float = 80.0
    bridge_gap_s: int = 20
    min_duration_s: int = 120
    min_turns: float = 2.0
    max_climb_ms: float = 8.0
    dense_spacing_s: float = 7.0
    nominal_circle_s: float = 20.0
    min_track_fixes: int = 5


def rolling_turn(fixes: DataFrame, window_s: int = 25) -> DataFrame:
    """Adds the turn at each interior fix and its trailing sum.

    End fixes have no turn; their ``turn`` and ``turn_sum`` are null.
    """
    order = track_order()
    here, ahead = (F.col("lat"), F.col("lon")), (F.lead("lat").over(order), F.lead("lon").over(order))
    outbound = fixes.withColumn("_out", bearing_deg(*here, *ahead))
    turned = outbound.withColumn("turn", signed_turn(F.lag("_out").over(order), F.col("_out"))).drop("_out")
    trailing = order.rangeBetween(-window_s, 0)
    return turned.withColumn("turn_sum", F.when(F.col("turn").isNotNull(), F.sum("turn").over(trailing)))


def rolling_confined(
    fixes: DataFrame, window_s: int = 120, radius_m: float = 400.0, min_points: int = 6
) -> DataFrame:
    """Adds ``confined``: the trailing fixes stay near their own centroid.

    The projection uses the mean latitude of the whole track. A window holds at
    most one fix per second, so its point list has at most 121 entries.
    """
    track_lat = F.avg("lat").over(whole_track())
    placed = fixes.withColumn("_y", EARTH_RADIUS_M * F.radians("lat")).withColumn(
        "_x", EARTH_RADIUS_M * F.radians("lon") * F.cos(F.radians(track_lat))
    )
    trailing = track_order().rangeBetween(-window_s, 0)
    windowed = placed.select(
        *fixes.columns,
        F.collect_list(F.struct("_x", "_y")).over(trailing).alias("_points"),
        F.avg("_x").over(trailing).alias("_cx"),
        F.avg("_y").over(trailing).alias("_cy"),
    )

    def distance(p):
        dx, dy = p["_x"] - F.col("_cx"), p["_y"] - F.col("_cy")
        return F.sqrt(dx * dx + dy * dy)

    farthest = F.array_max(F.transform("_points", distance))
    confined = (F.size("_points") >= min_points) & (farthest <= radius_m)
    return windowed.withColumn("confined", confined).drop("_points", "_cx", "_cy")


def phase_islands(flagged: DataFrame, gap_s: int = 20) -> DataFrame:
    """Numbers runs of ``circling`` interior fixes, bridging short false gaps.

    A run only breaks at a false fix more than ``gap_s`` after the last true
    one; a silent stretch alone never breaks it. Keeps the rows of each run,
    bridged false rows included, and adds ``phase_no``, ``phase_start_s`` and
    ``phase_end_s``.
    """
    order = track_order()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    true_time = F.when(F.col("circling"), F.col("t_s"))
    marked = flagged.select(
        "*",
        F.last(true_time, ignorenulls=True).over(before).alias("_prev_true"),
        F.lag("circling").over(order).alias("_prev_flag"),
        F.lag("t_s").over(order).alias("prev_t_s"),
    )
    broken = ~F.col("_prev_flag") & (F.col("prev_t_s") - F.col("_prev_true") > gap_s)
    opens = F.col("circling") & (F.col("_prev_true").isNull() | broken)
    numbered = marked.withColumn("phase_no", F.sum(opens.cast("int")).over(order)).where("phase_no > 0")
    phase = W.partitionBy(*TRACK, "phase_no")
    return (
        numbered.withColumn("phase_start_s", F.min("t_s").over(phase))
        .withColumn("phase_end_s", F.max(true_time).over(phase))
        .where("t_s <= phase_end_s")
        .drop("_prev_true", "_prev_flag")
    )


def phase_metrics(rows: DataFrame) -> DataFrame:
    """One row per phase with its duration, climb, turning and footprint."""
    phase = W.partitionBy(*TRACK, "phase_no")
    centred = rows.withColumn("_mlat", F.avg("lat").over(phase)).withColumn("_mlon", F.avg("lon").over(phase))
    dx = EARTH_RADIUS_M * F.radians(F.col("lon") - F.col("_mlon")) * F.cos(F.radians("_mlat"))
    dy = EARTH_RADIUS_M * F.radians(F.col("lat") - F.col("_mlat"))
    elapsed = (F.col("t_s") - F.col("phase_start_s")).cast("double")
    spacing = F.when(F.col("t_s") > F.col("phase_start_s"), F.col("t_s") - F.col("prev_t_s"))
    return centred.groupBy(*TRACK, "phase_no").agg(
        F.min("aircraft_type").alias("aircraft_type"),  # one value per track
        F.min("t_s").alias("t_start_s"),
        F.max("t_s").alias("t_end_s"),
        (F.max("t_s") - F.min("t_s")).alias("duration_s"),
        F.median("lat").alias("lat_centroid"),
        F.median("lon").alias("lon_centroid"),
        F.avg("alt_m").alias("alt_mean_m"),
        F.min_by("alt_m", "t_s").alias("alt_base_m"),
        F.max_by("alt_m", "t_s").alias("alt_top_m"),
        F.regr_slope(F.col("alt_m"), elapsed).alias("climb_rate_ms"),
        F.sum("turn").alias("turn_total_deg"),
        F.median(spacing).alias("spacing_s"),
        F.max(F.sqrt(dx * dx + dy * dy)).alias("radius_m"),
    )


def phase_classify(metrics: DataFrame, settings: PhaseSettings = PhaseSettings()) -> DataFrame:
    """Keeps real phases and names the evidence: measured turning or confinement."""
    s = settings
    turns = F.abs("turn_total_deg") / 360.0
    dense = F.col("spacing_s") <= s.dense_spacing_s
    by_turn = dense & (turns >= s.min_turns)
    gain = F.col("alt_top_m") - F.col("alt_base_m")
    by_footprint = (F.col("radius_m") <= s.confine_radius_m) & (gain >= s.confine_min_gain_m)
    return (
        metrics.where(F.col("duration_s") >= s.min_duration_s)
        .where(F.abs("climb_rate_ms") <= s.max_climb_ms)
        .where(by_turn | by_footprint)
        .withColumn("n_turns", F.when(dense, turns).otherwise(F.col("duration_s") / s.nominal_circle_s))
        .withColumn("turn_sign", F.when(F.col("turn_total_deg") >= 0, 1).otherwise(-1))
        .withColumn("method", F.when(by_turn, "turn").otherwise("confined"))
    )


def circling_flags(fixes: DataFrame, settings: PhaseSettings = PhaseSettings()) -> DataFrame:
    """Interior fixes of tracks long enough to judge, with their circling flag."""
    s = settings
    size = F.count(F.lit(1)).over(whole_track())
    long_enough = fixes.withColumn("_size", size).where(F.col("_size") >= s.min_track_fixes).drop("_size")
    turned = rolling_turn(long_enough, s.turn_window_s)
    both = rolling_confined(turned, s.confine_window_s, s.confine_radius_m, s.confine_min_fixes)
    circling = (F.abs("turn_sum") >= s.turn_min_deg) | F.col("confined")
    return both.where(F.col("turn").isNotNull()).withColumn("circling", circling)


PHASE_COLUMNS = [
    "day", "source_id", "aircraft_type", "t_start_s", "t_end_s", "duration_s",
    "lat_centroid", "lon_centroid", "alt_mean_m", "alt_base_m", "alt_top_m",
    "climb_rate_ms", "n_turns", "turn_sign", "method",
]


def detect_phases(fixes: DataFrame, settings: PhaseSettings = PhaseSettings()) -> DataFrame:
    """Circling phases of clean tracks, one row each."""
    rows = phase_islands(circling_flags(fixes, settings), settings.bridge_gap_s)
    return phase_classify(phase_metrics(rows), settings).select(*PHASE_COLUMNS)
