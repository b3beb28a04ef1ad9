"""From position observations to clean tracks.

Keys: one track is ``(day, source_id)``. After :func:`receiver_consensus` a
track holds at most one fix per second, so 86 400 rows: every window below is
bounded by that, however many copies of its packets an aircraft has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from updraft.functions.geo import haversine_m

TRACK = ["day", "source_id"]

# Speed and climb gates of the jump rejection, minimum fixes.
MAX_GROUND_SPEED_MS = 70.0
MAX_CLIMB_RATE_MS = 15.0
MIN_FIXES = 20
#: The clean layer keeps shorter tracks so that it serves several settings.
CLEAN_LAYER_MIN_FIXES = 5


def track_order():
    return W.partitionBy(*TRACK).orderBy("t_s")


def whole_track():
    """All rows of a track, on the same sort order as :func:`track_order`."""
    return track_order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def _consensus(observations: DataFrame, *carried: Column) -> DataFrame:
    medians = [F.median(c).alias(c) for c in ("lat", "lon", "alt_m")]
    return observations.groupBy(*TRACK, "t_s").agg(*carried, *medians)


def receiver_consensus(observations: DataFrame) -> DataFrame:
    """One fix per aircraft and GPS second: the median over its receivers.

    The shuffle key includes the second, and equal copies merge before it.
    """
    typed = "aircraft_type" in observations.columns
    return _consensus(observations, *[F.min("aircraft_type").alias("aircraft_type")] * typed)


def typed_consensus(observations: DataFrame) -> DataFrame:
    """The same with the track's type: that of its first packet in order of receipt.

    The first packet of each second travels along and the first of these is
    taken per track, on the partitioning that all later windows use. Without a
    receive time the second stands for it.
    """
    arrival = [c for c in ("ts_recv", "raw") if c in observations.columns] or ["t_s"]
    first = F.min(F.struct(*arrival, "aircraft_type")).alias("_first")
    fixes = _consensus(observations, first).withColumn("aircraft_type", F.min("_first").over(whole_track())["aircraft_type"])
    return fixes.select(*TRACK, "t_s", "aircraft_type", "lat", "lon", "alt_m")


def aircraft_type_first(observations: DataFrame) -> DataFrame:
    """Type of each track's first accepted packet, by receive time."""
    first = F.min_by("aircraft_type", F.struct("ts_recv", "raw"))
    return observations.groupBy(*TRACK).agg(first.alias("aircraft_type"))


def cap_aircraft(observations: DataFrame, n: int, arrival: list[str]) -> DataFrame:
    """Observations of the first ``n`` aircraft in order of arrival."""
    first_seen = observations.groupBy("source_id").agg(F.min(F.struct(*arrival)).alias("_first"))
    chosen = first_seen.orderBy("_first", "source_id").limit(n).select("source_id")
    return observations.join(chosen, "source_id", "left_semi")


def _spike_pass(fixes: DataFrame, max_speed: float, max_climb: float) -> DataFrame:
    order = track_order()

    def ahead(name: str) -> Column:
        return F.lead(name).over(order)

    def gap(later: Column, earlier: Column) -> Column:
        seconds = F.abs(later - earlier)
        return F.when(seconds == 0, F.lit(1.0)).otherwise(seconds.cast("double"))

    to_next = gap(ahead("t_s"), F.col("t_s"))
    stepped = fixes.select(
        "*",
        (haversine_m(F.col("lat"), F.col("lon"), ahead("lat"), ahead("lon")) / to_next).alias("_s2"),
        (F.abs(ahead("alt_m") - F.col("alt_m")) / to_next).alias("_c2"),
        F.lag("t_s").over(order).isNull().alias("_first"),
    )
    # A fix can only go when its step to the next fix breaks a gate; all others
    # stay and anchor the short run of suspects behind them.
    exceeds = (F.col("_s2") > max_speed) | (F.col("_c2") > max_climb)
    suspect = ~F.col("_first") & F.coalesce(exceeds, F.lit(False))
    runs = stepped.withColumn("_suspect", suspect).withColumn(
        "_run", F.sum(F.when(F.col("_suspect"), 0).otherwise(1)).over(order)
    )
    payload = [c for c in fixes.columns if c not in TRACK]
    row = F.struct("t_s", *[c for c in payload if c != "t_s"], "_s2", "_c2", "_suspect")
    members = runs.groupBy(*TRACK, "_run").agg(F.collect_list(row).alias("_rows"))

    def settle(state: Column, fix: Column) -> Column:
        last = F.element_at(state, -1)
        seconds = gap(fix["t_s"], last["t_s"])
        s1 = haversine_m(last["lat"], last["lon"], fix["lat"], fix["lon"]) / seconds
        c1 = F.abs(fix["alt_m"] - last["alt_m"]) / seconds
        drop = ((s1 > max_speed) & (fix["_s2"] > max_speed)) | ((c1 > max_climb) & (fix["_c2"] > max_climb))
        return F.when(F.coalesce(drop, F.lit(False)), state).otherwise(F.concat(state, F.array(fix)))

    anchored = F.array_sort("_rows")
    kept = F.when(F.size("_rows") == 1, F.col("_rows")).otherwise(
        F.aggregate(F.slice(anchored, 2, F.size("_rows") - 1), F.slice(anchored, 1, 1), settle)
    )
    return (
        members.select(*TRACK, F.explode(kept).alias("_fix"))
        .select(*TRACK, *[F.col(f"_fix.{c}").alias(c) for c in payload])
        .select(*fixes.columns)
    )


def spike_reject(
    fixes: DataFrame,
    max_speed: float = MAX_GROUND_SPEED_MS,
    max_climb: float = MAX_CLIMB_RATE_MS,
    passes: int = 2,
) -> DataFrame:
    """Drop there-and-back jumps judged against the last kept and the next fix."""
    for _ in range(passes):
        fixes = _spike_pass(fixes, max_speed, max_climb)
    return fixes


def min_fixes(fixes: DataFrame, n: int = MIN_FIXES) -> DataFrame:
    """Tracks with at least ``n`` fixes."""
    size = F.count(F.lit(1)).over(whole_track())
    return fixes.withColumn("_size", size).where(F.col("_size") >= n).drop("_size")


def clean_tracks(observations: DataFrame, n: int = MIN_FIXES) -> DataFrame:
    """Consensus, jump rejection and length filter for positioned observations."""
    typed = "aircraft_type" in observations.columns
    fixes = typed_consensus(observations) if typed else receiver_consensus(observations)
    return min_fixes(spike_reject(fixes), n)


def aircraft_track(fixes: DataFrame, day, source_id) -> DataFrame:
    """One aircraft's fixes in time order; both predicates reach the scan."""
    return fixes.where((F.col("day") == day) & (F.col("source_id") == source_id)).orderBy("t_s")
