"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source's words are cut into blocks of equal size. Sources receive blocks
by highest quotients, target / (2 s + 1) for the block after s; the shards of a
source receive its blocks in the same way by their sizes. Within a shard the
documents lie one after the other in a seeded order, and a seeded run of blocks
around that circle is taken, which begins anew where the shard ends. Blocks are
never listed: a document's share is the overlap of two intervals.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from updraft.llm.common import SPACE, cut_lineage, long_columns, map_exact, shielded

_WORD = re.compile(SPACE.replace("[", "[^") + "+")

#: Repeating weights of the sources in code-point order, null last.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and the most copies of a word.
SHARE, COPIES = 1.5, 2
#: Blocks into which the smallest source's target is cut at least, and the largest block.
LEAST_BLOCKS, BLOCK_WORDS = 128, 1024
#: Words in a shard, about. One task apportions a source's blocks among its shards.
SHARD_WORDS = 1_000_000
SEED = 73


def word_count(text) -> F.Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD.pattern)), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, copies: int = COPIES) -> np.ndarray:
    """Words per source: shares by weight that stop at ``copies`` times the size, the excess reshared."""
    caps = copies * sizes.astype(float)
    out = np.zeros(len(sizes))
    free = np.ones(len(sizes), bool)
    left = min(share * sizes.sum(), caps.sum())
    while free.any():
        part = left * weights[free] / weights[free].sum()
        over = part > caps[free]
        if not over.any():
            out[free] = part
            break
        at = np.flatnonzero(free)[over]
        out[at] = caps[at]
        left -= caps[at].sum()
        free[at] = False
    return out


def apportion(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Laguë seats by highest quotients, at most ``most`` each; ties go to the earlier one.

    All quotients above a divisor are awarded at once, the last few one by one.
    """
    votes = votes.astype(float)
    most = np.where(votes > 0, most, 0)
    seats = int(min(seats, most.sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)

    def awarded(divisor: float) -> np.ndarray:
        # Seats whose quotient votes / (2 s + 1) is above the divisor.
        return np.minimum(np.ceil(np.maximum(votes / divisor - 1, 0) / 2), most).astype(np.int64)

    lo, hi = votes[votes > 0].min() / (2 * (most.max() + 1) + 1), votes.max() + 1
    for _ in range(200):
        middle = (lo + hi) / 2
        if awarded(middle).sum() > seats:
            lo = middle
        else:
            hi = middle
    out = awarded(hi)
    queue = [(-votes[i] / (2 * out[i] + 1), i) for i in range(len(votes)) if out[i] < most[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _source_quotas(sizes: pd.DataFrame) -> pd.DataFrame:
    """Target, block size and blocks of every source; one row per source."""
    # Code-point order of strings, null last.
    keys = sizes["source"].where(sizes["source"].notna(), None)
    order = sorted(range(len(sizes)), key=lambda i: (keys.iloc[i] is None, keys.iloc[i] or ""))
    sizes = sizes.iloc[order].reset_index(drop=True)
    words = sizes["source_size"].to_numpy(np.int64)
    weights = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(words))], float)
    goal = targets(words, weights)
    least = goal[goal > 0].min() if (goal > 0).any() else 0
    block = int(np.clip(least // LEAST_BLOCKS, 1, BLOCK_WORDS))
    quotas = apportion(goal, round(goal.sum() / block), COPIES * -(-words // block))
    return sizes.assign(target=goal, block=block, blocks=quotas)


def _shard_quotas(shards: pd.DataFrame) -> pd.DataFrame:
    """Blocks of every shard of one source; one row per shard."""
    shards = shards.sort_values("shard", kind="stable")
    words = shards["shard_size"].to_numpy(np.int64)
    block = int(shards["block"].iloc[0])
    quotas = apportion(words, int(shards["blocks"].iloc[0]), COPIES * -(-words // block))
    return shards[["source", "shard", "shard_size", "block"]].assign(quota=quotas)


@dataclass
class Plan:
    """``sources`` (source, source_size, target, shards) and ``shards`` (source, shard, shard_size, block, quota)."""

    sources: DataFrame
    shards: DataFrame


def _sized(docs: DataFrame) -> DataFrame:
    turn = F.xxhash64(F.lit(SEED), "doc_id", F.xxhash64("text"))
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("_turn", turn)


def _sharded(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds the source's columns and the row's shard; ``sources`` has one row per source."""
    per_source = sources.withColumnRenamed("source", "_source")
    placed = rows.join(per_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return placed.withColumn("_shard", F.pmod(F.xxhash64(F.lit(SEED + 1), "_turn"), F.col("shards"))).drop("shards")


def plan(lines: DataFrame) -> Plan:
    """Quotas for stored ``lines`` (source, size, _turn)."""
    sizes = lines.groupBy("source").agg(F.sum("size").alias("source_size"))
    schema = "source string, source_size long, target double, block long, blocks long"
    quotas = cut_lineage(sizes.groupBy().applyInPandas(_source_quotas, schema), "quotas")
    # A source has shards by its size, so a hot source has many and none is large.
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).alias("shards")
    sources = quotas.select("source", "source_size", "target", shards)
    cells = _sharded(lines, sources).groupBy("source", F.col("_shard").alias("shard")).agg(F.sum("size").alias("shard_size"))
    blocks = quotas.select(F.col("source").alias("_source"), "block", "blocks")
    cells = cells.join(blocks, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    schema = "source string, shard long, shard_size long, block long, quota long"
    return Plan(sources, cut_lineage(cells.groupBy("source").applyInPandas(_shard_quotas, schema), "shards"))


def _placed(rows: DataFrame, found: Plan) -> DataFrame:
    """``rows`` with source_size, target, copies, the head and tail spans of words, and taken."""
    placed = _sharded(rows, found.sources)
    # Rows that tie in all of the order have equal ids and texts.
    before = Window.partitionBy("source", "_shard").orderBy("_turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_from", F.coalesce(F.sum("size").over(before), F.lit(0)))
    shards = found.shards.withColumnRenamed("source", "_source").withColumnRenamed("shard", "_number")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_number"))
    placed = placed.join(shards, same).drop("_source", "_number")
    # A shard's words form a circle: whole turns first, then a run from a seeded block on.
    size = F.greatest(F.col("shard_size"), F.lit(1))
    amount = F.least(F.col("quota") * F.col("block"), COPIES * F.col("shard_size"))
    first = F.pmod(F.xxhash64(F.lit(SEED + 2), "source", "_shard"), F.ceil(size / F.col("block"))) * F.col("block")
    placed = placed.withColumns({"_turns": F.floor(amount / size), "_first": first, "_end": first + amount % size})
    copies = F.when(F.col("size") > 0, F.col("_turns")).otherwise(0)
    tail = (F.col("_first"), F.least("_end", "shard_size"))
    head = (F.lit(0).cast("long"), F.greatest(F.col("_end") - F.col("shard_size"), F.lit(0)))
    spans = {"copies": copies}
    for name, (lo, hi) in {"head": head, "tail": tail}.items():
        a, b = F.greatest(F.col("_from"), lo), F.least(F.col("_from") + F.col("size"), hi)
        spans |= {f"{name}_{k}": F.when(b > a, v - F.col("_from")).otherwise(0) for k, v in (("from", a), ("to", b))}
    placed = placed.withColumns(spans)
    parts = F.col("head_to") - F.col("head_from") + F.col("tail_to") - F.col("tail_from")
    taken = F.col("copies") * F.col("size") + parts
    return placed.withColumn("taken", taken).drop("_turn", "_shard", "_from", "_turns", "_first", "_end", "shard_size", "block", "quota")


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``docs`` (doc_id, text, source).

    A document without words, or null, takes nothing. Null ids and repeated rows
    count like any others, a null source is a source of its own. An empty table
    gives an empty result; other columns are ignored.
    """
    lines = cut_lineage(_sized(docs.select("doc_id", "text", "source")).drop("text"), "lines")
    return _placed(lines, plan(lines)).select("doc_id", "size", "source_size", "target", "taken")


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        whole, parts = [], []
        for at, (text, copies, *edges) in enumerate(
            zip(*(batch[c] for c in ("text", "copies", "head_from", "head_to", "tail_from", "tail_to")), strict=True)
        ):
            whole += [(at, text)] * int(copies)
            spans = [(int(a), int(b)) for a, b in (edges[:2], edges[2:]) if b > a]
            if spans:
                words = list(_WORD.finditer(text))
                parts += [(at, text[words[a].start() : words[b - 1].end()]) for a, b in spans]
        rows = sorted(whole + parts, key=lambda r: r[0])
        out = batch.iloc[[r[0] for r in rows]].copy()
        out["text"] = [r[1] for r in rows]
        if "n_chars" in out:
            out["n_chars"] = [len(r[1]) for r in rows]
        yield out


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``, whatever their names: whole copies and parts cut at words.

    ``n_chars`` is renewed where it is there. Documents without words, or null, do
    not come; null ids and a null source count like any others. An empty table
    stays empty.
    """
    plain, restored = shielded(docs, "doc_id", "text", "source", "n_chars")
    lines = cut_lineage(_sized(plain.select("doc_id", "text", "source")).drop("text"), "lines")
    rows = _placed(_sized(plain), plan(lines)).where("taken > 0")
    wanted = rows.select(*plain.columns, "copies", "head_from", "head_to", "tail_from", "tail_to")
    passed = [c for c in long_columns(wanted) if c in plain.columns and c != "n_chars"]
    return restored(map_exact(wanted, _cut, wanted.schema, *passed))
