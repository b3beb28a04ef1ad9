"""Packet activity, watch list, phase statistics, file bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from updraft.operators.quantiles import group_quantiles, with_quantiles
from updraft.session import broadcast_if_small
from updraft.sources.beacons import parse_beacons, sender


def hourly_activity(raw: DataFrame) -> DataFrame:
    """Per day and UTC hour the distinct senders and all packets, zero filled.

    Senders are made distinct per hour before counting, so no hour's set of ids
    is ever held in one place.
    """
    tagged = raw.select("day", F.hour("ts_recv").alias("hour"), sender(F.col("raw")).alias("_id"))
    per_sender = tagged.groupBy("day", "hour", "_id").agg(F.count("*").alias("_n"))
    counted = per_sender.groupBy("day", "hour").agg(
        F.count("_id").alias("n_aircraft"), F.sum("_n").alias("n_packets")
    )
    hours = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    scaffold = counted.select("day").distinct().select("day", hours)
    full = scaffold.join(counted, ["day", "hour"], "left")
    return full.fillna(0, subset=["n_aircraft", "n_packets"])


#: Sketches of 2**12 registers: a standard error of 1.6 per cent, exact while the ids are few.
SKETCH_BITS = 12


def hourly_sketches(heard: DataFrame) -> DataFrame:
    """Per ``day`` and ``hour`` of (day, hour, _id) rows a sketch of the ids and the number of rows.

    The sketch has a bounded size whatever the traffic, and sketches unite: hours
    to days, batches to hours, receivers or regions to their sum.
    """
    return heard.groupBy("day", "hour").agg(F.hll_sketch_agg("_id", SKETCH_BITS).alias("senders"), F.count("*").alias("n_packets"))


def united_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_union_agg("senders").alias("senders"), F.sum("n_packets").alias("n_packets"))


def estimates(sketches: DataFrame) -> DataFrame:
    """The sketches' keys with ``n_aircraft``, an estimate, and the exact ``n_packets``."""
    keys = [c for c in sketches.columns if c not in ("senders", "n_packets")]
    return sketches.select(*keys, F.coalesce(F.hll_sketch_estimate("senders"), F.lit(0)).alias("n_aircraft"), "n_packets")


def peak_hour(activity: DataFrame) -> DataFrame:
    """Per day all packets and the hour with most aircraft, the first on ties."""
    rank = F.struct("n_aircraft", -F.col("hour"))
    return activity.groupBy("day").agg(F.sum("n_packets").alias("n_packets"), F.max_by("hour", rank).alias("peak_hour"))


def watched_lines(log: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Lines whose sender is on the list, found without parsing them."""
    watched = broadcast_if_small(watchlist.select(F.col("source_id").alias("_watched")).distinct())
    return log.join(watched, sender(F.col("raw")) == F.col("_watched"), "left_semi")


def watchlist_positions(log: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Per watched aircraft its packets and the fields of its last position.

    Takes the unparsed log: only the lines of watched aircraft reach the parser.
    Entries without packets stay, with a count of 0.
    """
    seen = parse_beacons(watched_lines(log, watchlist))
    is_position = F.col("kind") == "position"
    fields = F.struct("ts_recv", "lat", "lon", "alt_m", "climb_ms", "speed_kmh", "course_deg", "aircraft_type")
    last = F.max(F.when(is_position, F.struct("ts_recv", "raw", fields.alias("f"))))
    per_aircraft = seen.groupBy("source_id").agg(F.count("*").alias("packets"), last.alias("_last"))
    joined = watchlist.join(per_aircraft, "source_id", "left")
    return joined.select(
        *watchlist.columns,
        F.coalesce("packets", F.lit(0)).alias("packets"),
        F.col("_last.f.ts_recv").alias("last_seen"),
        *[F.col(f"_last.f.{c}").alias(c) for c in ("lat", "lon", "alt_m", "climb_ms", "speed_kmh", "course_deg", "aircraft_type")],
    )


def pending_days(logs: DataFrame, outputs: DataFrame, last_n: int | None = None) -> DataFrame:
    """Days with a log but no output, the last ``n`` of them if asked."""
    open_days = logs.select("day").distinct().join(outputs.select("day").distinct(), "day", "left_anti")
    if last_n is not None:
        open_days = open_days.orderBy(F.desc("day")).limit(last_n)
    return open_days.orderBy("day")


def prune_candidates(local: DataFrame, remote: DataFrame, keep_days: int, today: Column) -> DataFrame:
    """Local files by what may happen to them, with counts and bytes.

    The date comes from a ``YYYY/MM/DD/HH/...`` key. Files that cannot be dated,
    are recent, or lack a remote copy are kept.
    """
    date = F.try_to_date(F.regexp_extract("key", r"^(\d{4}/\d{2}/\d{2})/[^/]+/", 1), "yyyy/MM/dd")
    dated = local.withColumn("_date", date)
    confirmed = remote.select("key").distinct().withColumn("_remote", F.lit(True))
    joined = dated.join(confirmed, "key", "left")
    kind = (
        F.when(F.col("_date").isNull(), "undatable")
        .when(F.col("_date") >= F.date_sub(today, keep_days), "recent")
        .when(F.col("_remote").isNull(), "unconfirmed")
        .otherwise("deletable")
    )
    return joined.groupBy(kind.alias("class")).agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"))


def inventory_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys on one side only: ``missing`` from b, or ``orphan`` in b."""
    left, right = a.select("key").distinct(), b.select("key").distinct()
    sides = left.withColumn("_a", F.lit(True)).join(right.withColumn("_b", F.lit(True)), "key", "full")
    side = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "orphan")
    return sides.select("key", side.alias("side")).where("side IS NOT NULL")


def overlay_phases_on_track(fixes: DataFrame, phases: DataFrame) -> DataFrame:
    """Each fix with the start of the phase it belongs to, null outside phases.

    Phase starts and fixes are merged into one time order per track, so each fix
    looks back to the last start and checks its end. No pair is formed.
    """
    starts = phases.select("day", "source_id", F.col("t_start_s").alias("t_s"), F.lit(0).alias("_kind"), F.struct("t_start_s", "t_end_s").alias("_p"))
    rows = fixes.withColumn("_kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    order = W.partitionBy("day", "source_id").orderBy("t_s", "_kind").rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumn("_last", F.last("_p", ignorenulls=True).over(order)).where("_kind = 1")
    inside = F.col("t_s") <= F.col("_last.t_end_s")
    return seen.withColumn("phase_start_s", F.when(inside, F.col("_last.t_start_s"))).drop("_kind", "_p", "_last")


# -- statistics --------------------------------------------------------------


def phase_summary(phases: DataFrame) -> DataFrame:
    """Median and 90th percentile of climb, median and highest top, over a phase table."""
    counted = phases.agg(F.count("*").alias("n"), F.max("alt_top_m").alias("top_max_m"))
    wanted = {
        "climb_median_ms": ("climb_rate_ms", 0.5),
        "climb_q90_ms": ("climb_rate_ms", 0.9),
        "top_median_m": ("alt_top_m", 0.5),
    }
    return with_quantiles(counted, group_quantiles(phases, [], wanted), [])


def phase_stats_by_type(phases: DataFrame) -> DataFrame:
    """Per aircraft type, null included: count, climb of rising phases, median top."""
    keys = ["aircraft_type"]
    rising = phases.withColumn("_rising", F.when(F.col("climb_rate_ms") > 0, F.col("climb_rate_ms")))
    wanted = {
        "climb_median_ms": ("_rising", 0.5),
        "climb_q90_ms": ("_rising", 0.9),
        "top_median_m": ("alt_top_m", 0.5),
    }
    counted = phases.groupBy(*keys).agg(F.count("*").alias("n"))
    return with_quantiles(counted, group_quantiles(rising, keys, wanted), keys)


def class_counts(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Rows per class, with zero for the classes of the domain that do not occur."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    classes = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in domain])).alias(column))
    both = counted.unionByName(classes.withColumn("n", F.lit(0).cast("long")))
    return both.groupBy(column).agg(F.sum("n").alias("n"))


def layer_summary(regions: DataFrame, parent: str) -> DataFrame:
    """Row count, total area, bounds and distinct parents of a region layer."""
    return regions.agg(
        F.count("*").alias("n"),
        F.sum("area_km2").alias("total_area_km2"),
        F.min("x0").alias("min_lon"), F.min("y0").alias("min_lat"),
        F.max("x1").alias("max_lon"), F.max("y1").alias("max_lat"),
        F.count_distinct(parent).alias("n_parents"),
    )


def storage_totals(files: DataFrame) -> DataFrame:
    """Bytes per layer and the total over all layers (layer null)."""
    return files.rollup("layer").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"))
