"""Extensions the project documents describe: bins, spread, day types, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


MIN_SAMPLE = 5


def thermal_bins(phases: DataFrame, bin_s: int = 1800, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """Per region, day and half hour: circles, climb, highest top, sample flag."""
    start = F.floor(F.col("t_start_s") / bin_s) * bin_s
    binned = phases.withColumn("bin_start_s", start)
    keys = ["region_id", "day", "bin_start_s"]
    return binned.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum("n_turns").alias("n_circles"),
        F.max("alt_top_m").alias("top_max_m"),
        (F.count("*") >= min_sample).alias("enough"),
        # A region's phases of half an hour are few: exact percentiles in one aggregate.
        F.percentile("climb_rate_ms", F.lit(0.5)).alias("climb_median_ms"),
        F.percentile("climb_rate_ms", F.lit(0.9)).alias("climb_q90_ms"),
    )


def regional_spread(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Spread of cell values over a region.

    Needs ``cloud, base_m, u, v``: quartiles of cloud, median and valid share of
    the convection base, mean wind vector and its variance.
    """
    return cells.groupBy(*keys).agg(
        F.avg(F.col("base_m").isNotNull().cast("double")).alias("base_share"),
        F.sqrt(F.avg("u") * F.avg("u") + F.avg("v") * F.avg("v")).alias("wind_ms"),
        (F.var_pop("u") + F.var_pop("v")).alias("wind_variance"),
        # A region has a bounded number of cells, so its exact percentiles fit one buffer.
        F.percentile("cloud", F.lit(0.25)).alias("cloud_q25"),
        F.percentile("cloud", F.lit(0.5)).alias("cloud_median"),
        F.percentile("cloud", F.lit(0.75)).alias("cloud_q75"),
        F.percentile("base_m", F.lit(0.5)).alias("base_median_m"),
    )


def spread_by_height(cells: DataFrame, keys: list[str], value: str, class_m: int = 500) -> DataFrame:
    """Mean of a value by region and height class of its cell."""
    height_class = F.floor(F.col("elev_m") / class_m) * class_m
    return cells.groupBy(*keys, height_class.alias("height_class_m")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def day_type(features: DataFrame, base_share: float = 0.3, wet_share: float = 0.2) -> DataFrame:
    """Thunder when widely wet, cumulus when enough cells have a base, else blue."""
    kind = (
        F.when(F.col("wet_share") >= wet_share, "thunder")
        .when(F.col("base_share") >= base_share, "cumulus")
        .otherwise("blue")
    )
    return features.withColumn("day_type", kind)


def substep_events(slices: DataFrame, keys: list[str]) -> DataFrame:
    """Event marks in quarter-hour slices ``slice, base_m, rain_mm, flux, cape``.

    Onset is the first slice with a base; rain is short (1-2 wet slices) or
    lasting (more than 6); a peak holds for 3 slices or more within 10 % of the
    largest flux; a jump is a change of more than 500 between neighbours.
    """
    order = W.partitionBy(*keys).orderBy("slice")
    whole = W.partitionBy(*keys)
    near_peak = F.col("flux") >= 0.9 * F.max("flux").over(whole)
    staged = slices.withColumns(
        {
            "_near": near_peak,
            "_jump": F.abs(F.col("cape") - F.lag("cape").over(order)) > 500,
            "_gap": F.sum(F.when(near_peak, 0).otherwise(1)).over(order),
        }
    )
    held = F.count(F.when(F.col("_near"), 1)).over(W.partitionBy(*keys, "_gap"))
    wet = F.sum((F.col("rain_mm") > 0).cast("int"))
    marked = staged.withColumn("_held", held)
    return marked.groupBy(*keys).agg(
        F.min(F.when(F.col("base_m").isNotNull(), F.col("slice"))).alias("onset_slice"),
        F.when(wet > 6, "lasting").when((wet > 0) & (wet <= 2), "short").when(wet > 0, "medium").otherwise("none").alias("rain"),
        F.max(F.coalesce(F.col("_near") & (F.col("_held") >= 3), F.lit(False))).alias("sustained_peak"),
        F.max(F.coalesce("_jump", F.lit(False))).alias("jump"),
    )


def scores(observed: DataFrame, modelled: DataFrame, on: list[str], by: list[str], value: str) -> DataFrame:
    """Bias and root mean square error of the model against observations."""
    pairs = observed.select(*on, F.col(value).alias("_o")).join(modelled.select(*on, F.col(value).alias("_m")), on)
    off = F.col("_m") - F.col("_o")
    return pairs.groupBy(*by).agg(F.count(off).alias("n"), F.avg(off).alias("bias"), F.sqrt(F.avg(off * off)).alias("rmse"))


def observed_skill(bins: DataFrame, series: DataFrame, min_sample: int = MIN_SAMPLE, step_s: int = 3600) -> DataFrame:
    """How well mixed-layer series foretell observed thermals, by region and valid hour.

    ``bins`` are observed half hours (:func:`thermal_bins`), ``series`` steps of
    ``region_id, init_h, lead_h, z_top_m, w_star_ms``, and ``day`` where runs of
    several days are given. A bin belongs to the step in whose interval it starts.
    All runs that hold that hour count; ``n`` is the number of pairs and ``enough``
    says whether they reach ``min_sample``.
    """
    days = [c for c in ("day",) if c in series.columns]
    on = ["region_id", *days, "step"]
    start = F.pmod(F.col("bin_start_s"), F.lit(86_400))
    observed = bins.withColumn("step", F.floor(start / step_s)).select(*on, "climb_median_ms", "top_max_m")
    modelled = series.withColumn("step", F.floor((F.col("init_h") + F.col("lead_h")) * 3600 / step_s)).select(*on, "w_star_ms", "z_top_m")
    pairs = observed.join(modelled, on)
    climb, top = F.col("w_star_ms") - F.col("climb_median_ms"), F.col("z_top_m") - F.col("top_max_m")
    return pairs.groupBy("region_id", (F.col("step") * step_s / 3600).alias("valid_h")).agg(
        F.count("*").alias("n"),
        (F.count("*") >= min_sample).alias("enough"),
        F.avg(climb).alias("climb_bias_ms"),
        F.sqrt(F.avg(climb * climb)).alias("climb_rmse_ms"),
        F.avg(top).alias("top_bias_m"),
        F.sqrt(F.avg(top * top)).alias("top_rmse_m"),
    )


def class_accuracy(observed: DataFrame, modelled: DataFrame, on: list[str], column: str) -> DataFrame:
    """Share of matching classes."""
    pairs = observed.select(*on, F.col(column).alias("_o")).join(modelled.select(*on, F.col(column).alias("_m")), on)
    return pairs.agg(F.count("*").alias("n"), F.avg((F.col("_o") == F.col("_m")).cast("double")).alias("accuracy"))


def permeability(edges: DataFrame, tops: DataFrame, scale_m: Column | float = 500.0) -> DataFrame:
    """How freely air passes each edge: mixed-layer top over the pass, 0 to 1.

    ``tops`` has ``region_id, <time columns>, z_top_m``; the lower of the two
    neighbours' tops counts.
    """
    times = [c for c in tops.columns if c not in ("region_id", "z_top_m")]
    named = lambda side: tops.select(F.col("region_id").alias(f"region_{side}"), *times, F.col("z_top_m").alias(f"_z{side}"))
    both = edges.join(named("a"), "region_a").join(named("b"), ["region_b", *times])
    free = (F.least("_za", "_zb") - F.col("relative_threshold_m")) / scale_m
    return both.select("region_a", "region_b", *times, F.least(F.lit(1.0), F.greatest(F.lit(0.0), free)).alias("permeability"))


def message_rate(placed: DataFrame, window_s: int = 3600) -> DataFrame:
    """Packets and distinct senders per region and time window."""
    start = (F.floor(F.unix_timestamp("ts_recv") / window_s) * window_s).alias("window_start_s")
    per_sender = placed.groupBy("region_id", start, "source_id").agg(F.count("*").alias("_n"))
    return per_sender.groupBy("region_id", "window_start_s").agg(
        F.sum("_n").alias("packets"), F.count("source_id").alias("n_senders")
    )


def rank_regions(series: DataFrame, value: str) -> DataFrame:
    """Regions by seasonal spread of a value, largest first.

    The rank is over one row per region.
    """
    spread = series.groupBy("region_id").agg(F.stddev(value).alias("spread"), F.count(value).alias("n"))
    return spread.withColumn("rank", F.rank().over(W.orderBy(F.desc("spread"))))


def usable_sample(days: DataFrame, flights: DataFrame, quality: DataFrame) -> DataFrame:
    """Days with flights and of good quality."""
    return days.join(flights.select("day"), "day", "left_semi").join(quality.where("good").select("day"), "day", "left_semi")
