"""Product codes of vectors: short codes from one codebook per part, all in whole numbers.

Vectors are scaled to whole numbers and cut into equal parts. Each part has a
codebook that starts as the parts of the first vectors and is refined in rounds:
every part goes to its nearest entry, every entry becomes the floor of the mean
of its parts. Nearest entries come from a tree over each codebook (``gnat``).

Sums and counts per entry are formed in the tasks and added up by a grouping, so
a round moves a codebook's worth of rows per task. The codebooks, of a size that
no table changes, are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updraft.llm.common import map_exact, ship
from updraft.llm.gnat import Gnat
from updraft.session import broadcast_if_small, cut_lineage

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Scaled components beyond this cannot be coded: their squares would not fit a long.
LARGEST = 1 << 28


def _scaled(batch: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``batch`` that can be coded, and their whole-number vectors."""
    rows = [i for i, v in enumerate(batch) if len(v) == size]
    values = np.array([batch.iloc[i] for i in rows], np.float64).reshape(len(rows), size)
    values = np.floor(values * SCALE)
    fits = (np.abs(values) <= LARGEST).all(axis=1)
    return np.array(rows, np.int64)[fits], values[fits].astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and label of the rows whose vector is there and has finite components only."""
    component = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), "label")
    return rows.where(F.col("embedding").isNotNull() & F.forall("embedding", component))


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids; among equal ids the smaller vector comes first."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries)
    found = first.select("embedding").toPandas()["embedding"]  # at most ``entries`` rows
    if not len(found):
        return []
    size = len(found.iloc[0])
    if not size or size % parts:
        raise ValueError(f"a vector of {size} components cannot be cut into {parts} equal parts")
    _, values = _scaled(found, size)
    return list(values.reshape(len(values), parts, size // parts).transpose(1, 0, 2))


def _assigned(trees: list[Gnat], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry index and squared distance, one row per part."""
    pieces = np.split(values, len(trees), axis=1)
    found = [tree.nearest(piece) for tree, piece in zip(trees, pieces, strict=True)]
    return np.array([i for i, _ in found]), np.array([d for _, d in found])


def _sums(codebooks: list[np.ndarray]):
    parts, (entries, width) = len(codebooks), codebooks[0].shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [Gnat(c) for c in codebooks]
        sums = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            _, values = _scaled(batch["embedding"], parts * width)
            index, _ = _assigned(trees, values)
            for p in range(parts):
                np.add.at(sums[p], index[p], values[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(index[p], minlength=entries)
        part, entry = np.nonzero(counts)
        if len(part):
            yield pd.DataFrame({"part": part, "entry": entry, "n": counts[part, entry], "total": list(sums[part, entry])})

    return run


def refined(vectors: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """One round: entries that parts went to become the floor of those parts' mean."""
    width = codebooks[0].shape[1]
    rows = vectors.select("embedding").mapInPandas(_sums(codebooks), "part int, entry int, n long, total array<long>")
    sums = [F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(width)]
    after = [c.copy() for c in codebooks]
    # One row per entry of a codebook.
    for row in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        after[row.part][row.entry] = [row[f"t{k}"] // row.n for k in range(width)]
    return after


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def _codes(codebooks: list[np.ndarray]):
    size = len(codebooks) * codebooks[0].shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [Gnat(c) for c in codebooks]
        for batch in batches:
            rows, values = _scaled(batch["embedding"], size)
            index, squares = _assigned(trees, values)
            codes, errors = np.full(len(batch), None, object), np.full(len(batch), None, object)
            codes[rows] = [code.tobytes().hex() for code in index.T.astype(np.uint8)]
            errors[rows] = squares.sum(axis=0)
            found = {"vec_id": batch["vec_id"], "label": batch["label"], "code": codes, "error": pd.array(errors, "Int64")}
            yield pd.DataFrame(found)

    return run


def coded(vectors: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of usable vectors under given codebooks."""
    label = dict(vectors.dtypes)["label"]
    rows = vectors.select("vec_id", F.col("label").cast("string"), "embedding")
    found = map_exact(rows, _codes(codebooks), "vec_id long, label string, code string, error long", "vec_id")
    return found.withColumn("label", F.col("label").cast(label))


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that is null nowhere and finite.

    Null and repeated ids and labels stay as they are: rows with null labels share
    one label_error, rows with null ids come last in the first codebooks. The vector
    with the smallest id sets the number of components, a multiple of ``parts``; a
    vector of another length, or with a component beyond 2**20, gets a null code and
    error. An empty table gives an empty result; other columns are ignored. Up to
    256 entries, since a code has two hex digits a part.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    ship(vectors.sparkSession)
    rows = usable(vectors)
    first = first_codebooks(rows, parts, entries)
    if not first:
        schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    books = reduce(lambda now, _: refined(rows, now), range(rounds), first)
    found = cut_lineage(coded(rows, books), "codes")
    # Labels may be few and large: their sums form before the shuffle and come back as a small table.
    sums = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = found.join(broadcast_if_small(sums), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """One assignment and the codebook after it, as common table expressions."""
    return f"""
near{k} AS (
  SELECT vec_id, rid, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.rid, p.part, c.entry, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.v, c.v)])::BIGINT AS d
    FROM pieces p JOIN book{k} c ON p.part = c.part) GROUP BY ALL),
book{k + 1} AS (
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM book{k} c LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY k) AS v FROM (
      SELECT n.part, n.entry, u.k, floor(sum(u.x)::DOUBLE / count(*))::BIGINT AS mean
      FROM near{k} n JOIN flat u ON n.rid = u.rid AND n.part = u.part GROUP BY ALL) GROUP BY ALL) m
  ON c.part = m.part AND c.entry = m.entry)"""


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    books = ",".join(_round_sql(k) for k in range(rounds + 1))
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
         [floor(x::DOUBLE * {SCALE})::BIGINT for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pieces AS (
  SELECT rid, vec_id, p AS part, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v
  FROM kept, range({parts}) t(p)),
flat AS (SELECT rid, part, unnest(range(len(v))) AS k, unnest(v) AS x FROM pieces),
book0 AS (SELECT part, rid - 1 AS entry, v FROM pieces WHERE rid <= {entries}),
{books},
codes AS (
  SELECT vec_id, rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM near{rounds} GROUP BY ALL),
digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT c.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, d.codebooks_sha256
FROM codes c JOIN kept k ON c.rid = k.rid, digest d"""


SQL = _sql()
