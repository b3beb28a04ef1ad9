"""High terrain as one connected area on a cell table.

Masks are sets of ``(x, y)`` cells. Connectivity is by the four direct
neighbours, for the terrain as for its holes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from updraft.session import cut_lineage

STEPS = [(1, 0), (-1, 0), (0, 1), (0, -1)]
MAX_ROUNDS = 60


def block_means(pixels: DataFrame, factor: int) -> DataFrame:
    """Mean elevation of ``factor`` x ``factor`` pixel blocks."""
    block = [F.floor(F.col(c) / F.lit(float(factor))).alias(c) for c in ("x", "y")]
    return pixels.groupBy(*block).agg(F.avg("elev_m").alias("elev_m"))


def _neighbours(mask: DataFrame, include_self: bool) -> DataFrame:
    shifts = STEPS + ([(0, 0)] if include_self else [])
    moved = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in shifts])
    return mask.select(F.explode(moved).alias("c")).select("c.x", "c.y")


def _framed(cells: DataFrame, frame: tuple[int, int, int, int]) -> DataFrame:
    x0, y0, x1, y1 = frame
    return cells.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def dilate(mask: DataFrame, frame: tuple[int, int, int, int]) -> DataFrame:
    """The mask and its direct neighbours inside the frame."""
    return _framed(_neighbours(mask, True), frame).distinct()


def erode(mask: DataFrame) -> DataFrame:
    """Cells whose four neighbours all belong to the mask; the frame's rim erodes too."""
    votes = _neighbours(mask, True).groupBy("x", "y").agg(F.count("*").alias("n"))
    return votes.where("n = 5").select("x", "y")


def close_mask(mask: DataFrame, frame: tuple[int, int, int, int], rounds: int) -> DataFrame:
    """Dilates and then erodes ``rounds`` times."""
    for _ in range(rounds):
        mask = dilate(mask, frame)
    for _ in range(rounds):
        mask = erode(mask)
    return mask


def _runs(mask: DataFrame) -> DataFrame:
    """Cells with the id of their horizontal run; a row is at most the grid's width."""
    row = W.partitionBy("y").orderBy("x")
    starts = F.coalesce(F.col("x") - F.lag("x").over(row) > 1, F.lit(True))
    staged = mask.withColumn("_start", F.when(starts, F.col("x")))
    begin = F.last("_start", ignorenulls=True).over(row)
    return staged.select("x", "y", F.struct(F.col("y").alias("ry"), begin.alias("rx")).alias("run"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` edges to ``(node, component)``, the component being its least node.

    Alternating star contraction: every round hangs neighbours on the smallest
    node seen, so rounds grow with the logarithm of the component size. Each
    round is a grouped minimum and a join; no neighbour list is ever collected.
    """
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    links = cut_lineage(both, "links")
    before = None
    for _ in range(MAX_ROUNDS):
        sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small_least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            hung.select("u", F.col("m").alias("v"))
        )
        links = cut_lineage(small.where("u <> v").distinct(), "links")
        # One row: the edge count and an order-free checksum tell a fixed point.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError("components did not settle")


def label_mask(mask: DataFrame) -> DataFrame:
    """Cells with the smallest run of their component as ``component``.

    Rows of adjacent cells shrink to runs first, so the graph has a node per
    run and not per cell.
    """
    cells = cut_lineage(_runs(mask), "runs")
    above = cells.select("x", (F.col("y") + 1).alias("y"), F.col("run").alias("u"))
    touching = above.join(cells.select("x", "y", F.col("run").alias("v")), ["x", "y"]).select("u", "v").distinct()
    found = connected_components(touching)
    return cells.join(found, F.col("run") == F.col("node"), "left").select(
        "x", "y", F.coalesce("component", "run").alias("component")
    )


def fill_holes(mask: DataFrame, frame: tuple[int, int, int, int]) -> DataFrame:
    """Adds parts of the complement that do not reach the frame's rim."""
    x0, y0, x1, y1 = frame
    spark = mask.sparkSession
    rows = spark.range(y0, y1 + 1).select(F.col("id").alias("y"))
    everything = rows.select(F.explode(F.sequence(F.lit(x0).cast("long"), F.lit(x1).cast("long"))).alias("x"), "y")
    outside = label_mask(everything.join(mask, ["x", "y"], "left_anti"))
    rim = F.col("x").isin(x0, x1) | F.col("y").isin(y0, y1)
    open_parts = outside.where(rim).select("component").distinct()
    holes = outside.join(open_parts, "component", "left_anti").select("x", "y")
    return mask.select("x", "y").unionByName(holes)


def high_terrain_mask(blocks: DataFrame, frame: tuple[int, int, int, int], threshold_m: float = 1000.0, close_rounds: int = 3) -> DataFrame:
    """Cells at or above the threshold after closing."""
    return close_mask(blocks.where(F.col("elev_m") >= threshold_m).select("x", "y"), frame, close_rounds)


def high_terrain_component(
    blocks: DataFrame, frame: tuple[int, int, int, int], threshold_m: float = 1000.0, close_rounds: int = 3
) -> DataFrame:
    """Largest connected high area with its holes filled."""
    mask = cut_lineage(high_terrain_mask(blocks, frame, threshold_m, close_rounds), "mask")
    labelled = cut_lineage(label_mask(fill_holes(mask, frame)), "labels")
    sizes = labelled.groupBy("component").agg(F.count("*").alias("n"))
    largest = sizes.orderBy(F.desc("n"), "component").limit(1).select("component")
    return fill_holes(labelled.join(F.broadcast(largest), "component", "left_semi").select("x", "y"), frame)
