"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rank accuracy of the sketch that brackets each quantile.
ACCURACY = 10_000


def group_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact, linearly interpolated quantiles: ``{output: (column, share)}``.

    The built-in exact percentile keeps every distinct value of a group in one
    buffer. Here a bounded sketch first brackets each quantile; values below the
    bracket are only counted, and just the few inside it are ranked. ``df`` is
    read twice, so hand in a stored table. Null values do not count.
    """
    entries = [
        F.struct(F.lit(name).alias("_name"), F.lit(share).alias("_share"), F.col(column).cast("double").alias("_v"))
        for name, (column, share) in wanted.items()
    ]
    # Null keys form a group of their own, so joins below compare null-safely.
    long = df.select(*keys, F.inline(F.array(*entries))).where("_v IS NOT NULL")
    group = [*keys, "_name"]
    margin = 5.0 / ACCURACY
    sketched = []
    for share in sorted({share for _, share in wanted.values()}):
        bracket = [max(share - margin, 0.0), min(share + margin, 1.0)]
        sketched.append(F.when(F.col("_share") == share, F.percentile_approx("_v", bracket, ACCURACY)))
    brackets = long.groupBy(*group, "_share").agg(
        F.coalesce(*sketched).alias("_b"), F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    place = F.col("_share") * (F.col("_n") - 1)
    # One step of slack on both sides: the interpolation needs two neighbours.
    brackets = brackets.select(
        *group,
        "_n",
        place.alias("_place"),
        F.when(F.col("_n") <= 4 * ACCURACY, F.col("_min")).otherwise(F.col("_b")[0]).alias("_lo"),
        F.when(F.col("_n") <= 4 * ACCURACY, F.col("_max")).otherwise(F.col("_b")[1]).alias("_hi"),
    )
    left, right = long.alias("l"), brackets.alias("b")
    same = F.lit(True)
    for c in group:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = left.join(right, same).select(*[f"b.{c}" for c in group], "_n", "_place", "_lo", "_hi", "_v")
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    kept = joined.withColumn("_side", side).where("_side <= 0")
    # Equal values merge, and so does everything below the bracket.
    counted = kept.groupBy(*group, "_n", "_place", F.when(F.col("_side") == 0, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    rising = W.partitionBy(*group).orderBy(F.asc_nulls_first("_v"))
    upto = F.sum("_c").over(rising.rowsBetween(W.unboundedPreceding, 0))
    ranked = counted.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    at = lambda rank: F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))
    low, high = F.floor("_place"), F.ceil("_place")
    picked = ranked.groupBy(*group, "_place").agg(at(low).alias("_a"), at(high).alias("_z"))
    value = F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_place") - F.floor("_place"))
    # The margin is several times the sketch's error; a miss would still stop here.
    value = F.coalesce(value, F.raise_error(F.lit("quantile outside its bracket")).cast("double"))
    named = [F.max(F.when(F.col("_name") == name, value)).alias(name) for name in wanted]
    return picked.groupBy(*keys).agg(*named) if keys else picked.agg(*named)


def with_quantiles(summary: DataFrame, quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """Joins quantiles to a per-group summary, null keys included."""
    if not keys:
        # One row, so one subquery for all of its columns.
        row = summary.withColumn("_q", quantiles.select(F.struct(*quantiles.columns)).scalar())
        return row.select(*summary.columns, *[F.col(f"_q.{c}").alias(c) for c in quantiles.columns])
    left, right = summary.alias("s"), quantiles.alias("q")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"q.{c}"))
    extra = [f"q.{c}" for c in quantiles.columns if c not in keys]
    return left.join(right, same, "left").select("s.*", *extra)
