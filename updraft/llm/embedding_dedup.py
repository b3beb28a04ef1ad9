"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated by a random orthogonal matrix and stored, once per
distinct vector, as the signs of its coordinates (a bit each), one correction
factor, the inner product of the vector with its own signs, and a copy of the
rotated vector in 4-bit steps for the other side of a comparison. The inner
product of another vector's steps with the signs, in small whole numbers, divided by
the factor, estimates the cosine without bias: the steps are rounded at random by an
offset that depends on the coordinate alone. Factor and step width also give the
width of the estimate's confidence interval.

Only these codes travel with the bands. A first pass over a bucket's pairs of
blocks keeps, for every vector with an open pair, that is one whose interval
reaches the threshold, the bitmap of its open partners. Vectors are fetched for
those alone, once per pair of blocks, and the open pairs are computed exactly, in
double precision; what leaves is a count per vector and a spanning forest.

Candidates share their label and, in one of several bands, all signs of a few
further rotated coordinates. The signs per band grow with the logarithm of the
largest label, so buckets stay small, and the bands follow from the wanted miss
rate. Equal vectors collapse to one with a multiplicity. A bucket that is large
all the same is dealt out in pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updraft.llm.common import cut_lineage, map_exact
from updraft.operators.components import connected_components

COSINE = 0.93
#: Vectors of one label that shall meet in a bucket by chance.
BUCKET = 256
#: Chance that a pair at the threshold meets in no band.
MISS = 1e-4
#: Half width of the confidence interval in standard deviations.
WIDTH = 5.0
#: Vectors of one bucket in a block.
BLOCK = 1024
SEED = 40961
#: Bits and steps of a rotated coordinate on the asking side.
PLANES = 4
STEPS = 1 << PLANES
#: Open pairs computed at a time.
PAIRS = 1 << 16


@cache
def rotation(dim: int, number: int) -> np.ndarray:
    """Random orthogonal matrix; ``number`` 0 gives the codes, others the bands."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes(NamedTuple):
    """Stored codes of some vectors, a row each: what travels in place of them."""

    signs: np.ndarray  #: bits of the rotated coordinates' signs, in words
    planes: np.ndarray  #: the four bits of each step number, in words
    factor: np.ndarray
    low: np.ndarray  #: value of step 0
    step: np.ndarray  #: width of a step


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, filled up with zeros."""
    packed = np.packbits(bits, axis=-1)
    fill = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (bits.ndim - 1) + [(0, fill)])).view(np.uint64)


def _bits(words: np.ndarray, count: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, count=count)


def _numbers(code: Codes, dim: int) -> np.ndarray:
    """Step numbers of the rotated coordinates."""
    return sum(_bits(code.planes[:, k], dim).astype(np.float32) * (1 << k) for k in range(PLANES))


def codes(unit: np.ndarray) -> Codes:
    """Codes of unit vectors; a vector's code depends on nothing else."""
    dim = unit.shape[1]
    turned = unit @ rotation(dim, 0).T
    positive = turned >= 0
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (STEPS - 1), np.finfo(float).tiny)
    offset = np.random.default_rng([SEED, dim]).random(dim)
    number = np.clip(np.floor((turned - low[:, None]) / step[:, None] + offset), 0, STEPS - 1).astype(np.uint8)
    planes = np.stack([_words(number >> k & 1) for k in range(PLANES)], axis=1)
    factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
    return Codes(_words(positive), planes, factor, low, step)


def estimates(dim: int, asked: Codes, coded: Codes, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of all of ``asked``, by their steps, with all of ``coded``, by their signs, and interval half widths."""
    # Sums of whole numbers far below 2**24: single precision holds them exactly.
    numbers, ones = _numbers(asked, dim), _bits(coded.signs, dim).astype(np.float32)
    total = numbers @ ones.T
    product = asked.step[:, None] * (2 * total - numbers.sum(axis=1)[:, None]) + asked.low[:, None] * (2.0 * ones.sum(axis=1) - dim)
    coded_spread = np.maximum(0.0, 1 - coded.factor**2) / max(1, dim - 1)
    # A step rounded at random is off by half its width at most in the standard deviation.
    spread = np.sqrt(coded_spread + (asked.step[:, None] / 2) ** 2) / coded.factor
    return product / math.sqrt(dim) / coded.factor, width * spread


def band_plan(largest: int, cosine: float) -> tuple[int, int]:
    """Signs per band and number of bands for a label of ``largest`` vectors."""
    signs = max(1, math.ceil(math.log2(max(2, largest / BUCKET))))
    agree = 1 - math.acos(cosine) / math.pi
    return signs, max(1, math.ceil(math.log(MISS) / math.log1p(-(agree**signs))))


def _stack(raw: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f4").reshape(len(raw), -1).astype(np.float64)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as bytes; null where a vector links with nothing."""
    for batch in batches:
        out = []
        for vector, label in zip(batch["embedding"], batch["label"], strict=True):
            if vector is None or pd.isna(label) or not len(vector):
                out.append(None)
                continue
            # Adding zero turns -0.0 into 0.0, so equal vectors have equal bytes.
            values = np.array([np.nan if v is None else v for v in vector], "<f4") + np.float32(0)
            out.append(values.tobytes() if np.isfinite(values).all() and values.any() else None)
        yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "vector": out})


def _coded(signs: int, bands: int):
    """Codes and band keys of each class; ``marks`` are the bits of all band keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby(batch["vector"].str.len()):
                dim = size // 4
                unit = _stack(part["vector"])
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                turned = [unit @ rotation(dim, 1 + k).T for k in range(-(-signs * bands // dim))]
                bits = (np.hstack(turned)[:, : signs * bands] >= 0).reshape(len(part), bands, signs)
                keys = (bits * (1 << np.arange(signs, dtype=np.int64))).sum(axis=2)
                code = codes(unit)
                yield part.drop(columns="vector").assign(
                    size=size,
                    keys=list(keys),
                    marks=[m.tobytes() for m in np.packbits(bits.reshape(len(part), -1), axis=1)],
                    signs=[row.tobytes() for row in code.signs],
                    planes=[row.tobytes() for row in code.planes],
                    factor=code.factor,
                    low=code.low,
                    step=code.step,
                )

    return run


def _keys(marks: pd.Series, bands: int, signs: int) -> np.ndarray:
    """Keys of the first bands."""
    bits = np.unpackbits(np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), -1), axis=1, count=bands * signs)
    return bits.reshape(len(marks), bands, signs) @ (1 << np.arange(signs, dtype=np.int64))


def _unpacked(group: pd.DataFrame) -> Codes:
    signs = np.frombuffer(b"".join(group["signs"]), np.uint64).reshape(len(group), -1)
    planes = np.frombuffer(b"".join(group["planes"]), np.uint64).reshape(len(group), PLANES, -1)
    return Codes(signs, planes, *(group[c].to_numpy() for c in ("factor", "low", "step")))


_CODED = "label long, class long, size int, keys array<long>, marks binary, signs binary, planes binary, factor double, low double, step double"
_BLOCKS = ["label", "size", "band", "bucket", "lo", "hi"]
_OPEN = "label long, size int, band int, bucket long, lo long, hi long, class long, upper boolean, place int, open binary"


def _open(cosine: float, signs: int, width: float):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """Members of a pair of blocks that have an open pair: their places, and on the lower side a bitmap of the upper side's."""
        dim, band, lo, hi = int(key[1]) // 4, int(key[2]), int(key[4]), int(key[5])
        group = group.sort_values("class", kind="stable")
        below, above = group[group["block"] == lo], group[group["block"] == hi]
        left, right = _unpacked(below), _unpacked(above)
        about, reach = estimates(dim, left, right, width)
        back, back_reach = estimates(dim, right, left, width)
        pairs = (about + reach >= cosine) & (back + back_reach >= cosine).T
        if lo == hi:
            pairs = np.triu(pairs, 1)
        if band:  # an earlier band has the pair
            mine, theirs = (_keys(side["marks"], band, signs) for side in (below, above))
            for k in range(band):
                pairs &= mine[:, k, None] != theirs[None, :, k]
        rows, columns = np.flatnonzero(pairs.any(axis=1)), np.flatnonzero(pairs.any(axis=0))
        bitmaps = [m.tobytes() for m in np.packbits(pairs[rows], axis=1)]
        sides = [
            pd.DataFrame({"class": below["class"].to_numpy()[rows], "upper": False, "place": rows, "open": bitmaps}),
            pd.DataFrame({"class": above["class"].to_numpy()[columns], "upper": True, "place": columns, "open": [None] * len(columns)}),
        ]
        return pd.concat(sides).assign(**dict(zip(_BLOCKS, key, strict=True)))[[*_BLOCKS, "class", "upper", "place", "open"]]

    return run


def _exact(cosine: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links of one pair of blocks: per class its weighted number and a spanning forest's root."""
        # A vector may stand on both sides of a block with itself; nodes by order, so the least position is the least node.
        node, times, vectors = (group[c] for c in ("node", "times", "vector"))
        members = pd.DataFrame({"class": group["class"], "node": node, "times": times, "vector": vectors})
        members = members.drop_duplicates("class").sort_values(["node", "class"], kind="stable").reset_index(drop=True)
        at_class = pd.Series(members.index, members["class"])
        unit = _stack(members["vector"])
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        upper = group["upper"].to_numpy(bool)
        below, above = group[~upper], group[upper]
        held = np.full(int(above["place"].max()) + 1, -1)
        held[above["place"]] = at_class[above["class"]]
        rows = at_class[below["class"]].to_numpy()
        bits = np.unpackbits(np.frombuffer(b"".join(below["open"]), np.uint8).reshape(len(below), -1), axis=1)
        x, y = np.nonzero(bits)
        a, b = rows[x], held[y]
        near = [np.zeros(0, bool)]
        for at in range(0, len(a), PAIRS):
            near.append(np.einsum("ij,ij->i", unit[a[at : at + PAIRS]], unit[b[at : at + PAIRS]]) >= cosine)
        near = np.concatenate(near)
        a, b = a[near], b[near]
        weight = members["times"].to_numpy()
        links = np.bincount(a, weight[b], len(members)) + np.bincount(b, weight[a], len(members))
        root = np.arange(len(members))
        while len(a):
            least = root.copy()
            np.minimum.at(least, root[a], root[b])
            np.minimum.at(least, root[b], root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least[root]
        used = links > 0
        nodes = members["node"].to_numpy()
        found = {"class": members["class"][used], "node": nodes[used], "links": links[used].astype(np.int64), "root": nodes[root][used]}
        return pd.DataFrame(found)

    return run


def open_pairs(classes: DataFrame, signs: int, bands: int, cosine: float, width: float = WIDTH) -> DataFrame:
    """Per pair of blocks its members with an open pair, decided by the codes of ``classes`` (label, vector, class) alone."""
    coded = cut_lineage(classes.select("label", "vector", "class").mapInPandas(_coded(signs, bands), _CODED), "codes")
    keys = F.posexplode("keys").alias("band", "bucket")
    bucket = ["label", "size", "band", "bucket"]
    full = coded.select("label", "size", keys).groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("n"))
    full = full.where("n > 1").drop("n")
    entries = coded.select("*", keys).drop("keys").join(full, bucket).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = entries.select("*", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    dealt = dealt.drop("blocks", "other")
    return cut_lineage(dealt.groupBy(*_BLOCKS).applyInPandas(_open(cosine, signs, width), _OPEN), "open")


def embedding_links(vectors: DataFrame, cosine: float = COSINE, width: float = WIDTH) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding, label).

    Only vectors of one label and one length are compared. A vector that is null,
    empty, zero or not finite links with nothing, nor does one without label or
    id. ``width`` is the half width of the intervals in standard deviations. Repeated rows count as vectors of their own. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<float>"))
    rows = cut_lineage(map_exact(rows, _packed, "vec_id long, label long, vector binary", "vec_id", "label"), "vectors")
    usable = rows.where("vector IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    classes = usable.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("times"))
    # The number is stable because the table is stored; an id may have several vectors.
    classes = cut_lineage(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    signs, bands = band_plan(largest, cosine)
    fetched = open_pairs(classes, signs, bands, cosine, width).join(classes.select("class", "node", "times", "vector"), "class")
    found = fetched.groupBy(*_BLOCKS).applyInPandas(_exact(cosine), "class long, node long, links long, root long")
    found = cut_lineage(found, "links")
    counted = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct())

    # Copies link with one another and share the links of their class.
    per_class = classes.join(counted, "class", "left").join(joined, "node", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "node").alias("part")
    )
    result = rows.join(per_class.where("links > 0"), ["label", "vector"], "left")
    in_class = F.col("links").isNotNull() & F.col("vec_id").isNotNull()
    component = F.when(in_class, F.col("part")).otherwise(F.col("vec_id"))
    return result.select(
        "vec_id",
        F.when(in_class, F.col("links")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


#: The same in SQL, by comparing all pairs of a label.
SQL = """
WITH v AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(embedding) AS x) WHERE x IS NULL OR NOT isfinite(x))
    AND EXISTS (SELECT 1 FROM (SELECT unnest(embedding) AS x) WHERE x <> 0)
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93
), reach AS (
  WITH RECURSIVE r(node, least) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION SELECT links.b, r.least FROM r JOIN links ON links.a = r.node WHERE r.least < links.b
  ) SELECT node, min(least) AS least FROM r GROUP BY node
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, reach.least AS component_id, e.vec_id = reach.least AS kept
FROM embeddings e JOIN reach ON reach.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
