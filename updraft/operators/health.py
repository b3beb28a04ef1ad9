"""Run manifest and job health. Every time-dependent operator takes ``now``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from updraft.session import broadcast_if_small

# Allowed age of a job's last attempt, and of a failing streak.
THRESHOLDS_S = {
    "tier1-00": 26 * 3600,
    "tier1-03": 26 * 3600,
    "tier1-06": 26 * 3600,
    "tier1-09": 26 * 3600,
    "tier2-decision": 26 * 3600,
    "tier2-download": 26 * 3600,
    "ogn-stream": 30 * 60,
}
FAIL_STREAK_S = 6 * 3600
ACTIVE_MIN = 15

RUN = ["init_date", "init_h"]


# -- manifest ----------------------------------------------------------------


def has_record(keys: DataFrame, manifest: DataFrame, on: list[str]) -> DataFrame:
    """Keys with a record of any outcome."""
    return keys.join(manifest.select(*on).distinct(), on, "left_semi")


def has_successful_record(keys: DataFrame, manifest: DataFrame, on: list[str]) -> DataFrame:
    """Keys with a record that brought files; a failed one never blocks a retry."""
    return has_record(keys, manifest.where("files_ok > 0"), on)


def pending_targets(manifest: DataFrame, target: list[str] = RUN) -> DataFrame:
    """Latest fired decision of each target that has not been downloaded yet.

    A later decision that did not fire cancels nothing.
    """
    fired = manifest.where((F.col("tier") == "tier2_decision") & F.col("fire"))
    payload = [c for c in manifest.columns if c not in target]
    latest = fired.groupBy(*target).agg(F.max_by(F.struct(*payload), "seq").alias("_row"))
    done = manifest.where(F.col("tier") == "tier2").select(*target).distinct()
    return latest.join(done, target, "left_anti").select(*target, "_row.*").orderBy(*target)


def manifest_summary(manifest: DataFrame, target: list[str] = RUN) -> DataFrame:
    """Records per tier, fired decisions, pending targets, bytes; one row.

    Targets are judged per key and then summed: one shuffle of partial sums.
    """
    decision = (F.col("tier") == "tier2_decision") & F.col("fire")
    flag = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    per_target = manifest.groupBy(*target).agg(
        flag(F.col("tier") == "tier1").alias("t1"),
        flag(F.col("tier") == "tier2_decision").alias("td"),
        flag(F.col("tier") == "tier2").alias("t2"),
        flag(decision).alias("fired"),
        F.count("*").alias("n"),
        F.sum("bytes_on_disk").alias("bytes"),
    )
    waiting = ((F.col("fired") > 0) & (F.col("t2") == 0)).cast("long")
    return per_target.agg(
        F.sum("n").alias("records"),
        F.sum("t1").alias("tier1"),
        F.sum("td").alias("tier2_decision"),
        F.sum("t2").alias("tier2"),
        F.sum("fired").alias("fired_decisions"),
        F.sum(waiting).alias("pending_downloads"),
        F.sum("bytes").alias("total_bytes"),
    )


def last_records(manifest: DataFrame, n: int = 10) -> DataFrame:
    """Last ``n`` records in append order."""
    return manifest.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def status_report(manifest: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Last records and the one-row summary."""
    return last_records(manifest, n), manifest_summary(manifest)


def calendar(manifest: DataFrame, init_hours: tuple[int, ...]) -> DataFrame:
    """Completeness of surface runs, a row per date and a column per init hour."""
    tier1 = manifest.where(F.col("tier") == "tier1")
    share = F.when(F.sum("files_attempted") > 0, F.sum("files_ok") / F.sum("files_attempted")).otherwise(0.0)
    return tier1.groupBy("init_date").pivot("init_h", list(init_hours)).agg(share)


def trigger_history(manifest: DataFrame) -> DataFrame:
    """Decisions with their metrics in columns; needs the nested ``trigger``."""
    decisions = manifest.where(F.col("tier") == "tier2_decision")
    metric = lambda name: F.col(f"trigger.metrics.{name}").alias(name)
    return decisions.select(
        F.col("init_utc").alias("target_init"),
        F.coalesce("decision_init_utc", F.lit("—")).alias("decision_init"),
        F.coalesce("trigger.fire", F.lit(False)).alias("fire"),
        F.coalesce("trigger.reason", F.lit("—")).alias("reason"),
        metric("cape_cover_frac"),
        metric("rad_cover_frac"),
        metric("htop_dc_cover_frac"),
        metric("wet_frac"),
    )


def fired_metrics(history: DataFrame) -> DataFrame:
    """Metrics of fired decisions in long form."""
    names = ["cape_cover_frac", "rad_cover_frac", "htop_dc_cover_frac"]
    return history.where("fire").unpivot(["target_init"], names, "metric", "value")


# -- job state ---------------------------------------------------------------

STATE = ["job", "last_attempt", "last_status", "since", "last_success"]


def job_state(attempts: DataFrame) -> DataFrame:
    """State of each job from its attempts: ``job, ts, status, seq``.

    With a column ``extra`` the last attempt's goes along as ``last_extra``.

    The current streak starts at the first attempt after the last one with
    another status. Three grouped extrema find it, so a job with most of all
    attempts is still merged before the shuffle.
    """
    at = F.struct("ts", "seq")
    final = attempts.groupBy("job").agg(
        F.max(at).alias("_last"),
        F.max_by("status", at).alias("last_status"),
        F.max(F.when(F.col("status") == "ok", F.col("ts"))).alias("last_success"),
        *[F.max_by(c, at).alias(f"last_{c}") for c in ("extra",) if c in attempts.columns],
    )
    # Latest attempt per job and status, a handful of rows per job.
    per_status = attempts.groupBy("job", "status").agg(F.max(at).alias("_at"))
    other = (
        per_status.join(final.select("job", "last_status"), "job")
        .where("status <> last_status")
        .groupBy("job")
        .agg(F.max("_at").alias("_broken"))
    )
    marks = final.join(other, "job", "left").select("job", "_broken")
    streak = (
        attempts.join(marks, "job")
        .where(F.col("_broken").isNull() | (at > F.col("_broken")))
        .groupBy("job")
        .agg(F.min("ts").alias("since"))
    )
    return final.join(streak, "job").select(
        "job", F.col("_last.ts").alias("last_attempt"), "last_status", "since", "last_success",
        *[c for c in ("last_extra",) if c in final.columns],
    )


def merge_job_state(previous: DataFrame, batch: DataFrame) -> DataFrame:
    """State after a batch of later attempts, from the stored state alone.

    The stored state enters as two attempts: its streak start and its last one.
    """
    replay = [
        previous.select("job", F.col(c).alias("ts"), F.col("last_status").alias("status"), F.lit(s).cast("long").alias("seq"))
        for c, s in (("since", -2), ("last_attempt", -1))
    ]
    attempts = batch.select("job", "ts", "status", "seq")
    merged = job_state(attempts.unionByName(replay[0]).unionByName(replay[1]))
    known = previous.select("job", F.col("last_success").alias("_before"))
    joined = merged.join(known, "job", "left")
    return joined.withColumn("last_success", F.greatest("last_success", "_before")).select(*STATE)


def default_thresholds(state: DataFrame) -> DataFrame:
    """The fixed allowed ages as a table."""
    return state.sparkSession.createDataFrame(list(THRESHOLDS_S.items()), "job STRING, threshold_s BIGINT")


def alerts(state: DataFrame, thresholds: DataFrame | None, now: Column, fail_streak_s: int = FAIL_STREAK_S) -> DataFrame:
    """Missing, stale and stuck jobs; a stale job is not also reported stuck.

    ``thresholds`` has ``job, threshold_s``; None takes the fixed ones.
    """
    thresholds = default_thresholds(state) if thresholds is None else thresholds
    joined = thresholds.join(state, "job", "left").withColumn("_now", now)
    seconds = lambda c: F.unix_timestamp("_now") - F.unix_timestamp(c)
    age, streak = seconds("last_attempt"), seconds("since")
    kind = (
        F.when(F.col("last_attempt").isNull(), "missing")
        .when(age > F.col("threshold_s"), "stale")
        .when((F.col("last_status") == "fail") & (streak > fail_streak_s), "stuck-fail")
    )
    iso = F.date_format("since", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    hours = lambda c: F.format_string("%.1f", c / 3600.0)
    detail = (
        F.when(F.col("kind") == "missing", "no heartbeat recorded (job never ran?)")
        .when(
            F.col("kind") == "stale",
            F.concat(F.lit("last attempt "), hours(age), F.lit(" h ago, threshold "), hours(F.col("threshold_s")), F.lit(" h")),
        )
        .otherwise(F.concat(F.lit("status=fail for "), hours(streak), F.lit(" h (streak start "), iso, F.lit(")")))
    )
    age_s = F.when(F.col("kind") == "stale", age).when(F.col("kind") == "stuck-fail", streak)
    return (
        joined.withColumn("kind", kind)
        .where("kind IS NOT NULL")
        .select("job", "kind", detail.alias("detail"), "last_attempt", "last_success", age_s.alias("age_s"))
    )


def alerts_by_kind(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("n"))


def alert_text(found: DataFrame) -> DataFrame:
    """One line per alert."""
    iso = F.date_format("last_success", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.concat_ws(
        " — ",
        F.concat(F.lit("["), F.upper("kind"), F.lit("] "), F.col("job")),
        F.col("detail"),
        F.when(F.col("age_s").isNotNull(), F.concat(F.lit("age="), F.format_string("%.1f", F.col("age_s") / 60.0), F.lit(" min"))),
        F.when(F.col("last_success").isNotNull(), F.concat(F.lit("last_ok="), iso)),
    )
    return found.select("job", line.alias("text"))


def unexpected_jobs(state: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Jobs that report without a threshold."""
    return state.join(broadcast_if_small(thresholds.select("job")), "job", "left_anti")


def last_success(state: DataFrame, prefix: str) -> DataFrame:
    """Latest success over the jobs whose name starts with the prefix."""
    return state.where(F.col("job").startswith(prefix)).agg(F.max("last_success").alias("last_success"))


def job_window_status(packets: DataFrame, tick_s: int = 240) -> DataFrame:
    """Keep-alive ticks: packets since the last tick, running total, ok or fail.

    The packets are counted per tick first; the dense scaffold and the running
    sum work on that table, one row per tick of the covered time.
    """
    tick = F.floor(F.unix_timestamp("ts_recv") / tick_s).alias("tick")
    counted = packets.groupBy(tick).agg(F.count("*").alias("n"))
    span = counted.agg(F.min("tick").alias("_a"), F.max("tick").alias("_b"))
    ticks = span.select(F.explode(F.sequence("_a", "_b")).alias("tick"))
    full = ticks.join(counted, "tick", "left").withColumn("packets", F.coalesce("n", F.lit(0)))
    # Running total in two levels: inside each day, plus the days before it.
    full = full.withColumn("_day", F.floor(F.col("tick") * tick_s / 86_400))
    per_day = full.groupBy("_day").agg(F.sum("packets").alias("_sum"))
    earlier = F.sum("_sum").over(W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1))
    shifts = per_day.select("_day", F.coalesce(earlier, F.lit(0)).alias("_shift"))
    inside = F.sum("packets").over(W.partitionBy("_day").orderBy("tick").rowsBetween(W.unboundedPreceding, 0))
    summed = full.withColumn("_run", inside).join(shifts, "_day")
    return summed.select(
        F.timestamp_seconds(F.col("tick") * tick_s).alias("tick_start"),
        "packets",
        (F.col("_run") + F.col("_shift")).alias("total_packets"),
        F.when(F.col("packets") > 0, "ok").otherwise("fail").alias("status"),
    )


def active_flag(positions: DataFrame, now: Column, active_min: int = ACTIVE_MIN) -> DataFrame:
    """Age of each position and whether the aircraft counts as airborne."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("last_seen")) / 60.0
    return positions.select(
        "*",
        F.round(age, 1).alias("age_min"),
        F.coalesce(age < active_min, F.lit(False)).alias("is_active"),
        F.round("alt_m", 0).alias("height_m"),
        F.round("climb_ms", 1).alias("climb_rounded_ms"),
        F.round("speed_kmh", 0).alias("speed_rounded_kmh"),
    )


def located(positions: DataFrame) -> DataFrame:
    """Positions that can go on a map."""
    return positions.where("lat IS NOT NULL AND lon IS NOT NULL")
