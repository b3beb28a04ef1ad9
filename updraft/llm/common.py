"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from updraft.session import cut_lineage, scratch_path

#: The six white-space characters the operators split at.
SPACE = r"[\x20\x09-\x0D]"

#: Documents in an Arrow batch.
BATCH_DOCUMENTS = 500
_BATCH_ROWS, _DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"

__all__ = ["SPACE", "cut_lineage", "fresh_name", "held_out", "in_pieces", "long_columns", "map_exact", "mix64", "scratch_path", "seeded", "shielded", "ship", "table", "tidied", "unit_hash"]


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each Spark context.

    Tasks run its functions wherever the driver was started from and whatever
    the executors have installed. Unless the session says otherwise, Arrow batches
    get smaller, since a row here is a whole document and not a few numbers.
    """
    if spark.conf.get(_BATCH_ROWS, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_BATCH_ROWS, str(BATCH_DOCUMENTS))
    context = spark.sparkContext
    if getattr(context, "_updraft_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="updraft-code-")) / "updraft.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._updraft_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_columns(rows: DataFrame) -> list[str]:
    return [f.name for f in rows.schema if isinstance(f.dataType, LongType)]


def give_back() -> None:
    """Returns the memory that this process has freed but still holds to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidied(run: Callable) -> Callable:
    """``run`` for ``mapInPandas``; at its end the worker gives back what it has freed.

    Workers outlive their tasks and wait for the next ones. An executor has several,
    and what each held in its largest task would add up.
    """

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def map_exact(rows: DataFrame, run: Callable, schema: str | StructType, *names: str) -> DataFrame:
    """``mapInPandas`` that hands the named longs through as texts.

    Beside a null, pandas makes floats of a batch's longs, which rounds them above 2**53.
    """
    ship(rows.sparkSession)
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    sent = StructType([StructField(f.name, StringType()) if f.name in names else f for f in kinds])
    texts = rows.withColumns({n: F.col(f"`{n}`").cast("string") for n in names})
    return texts.mapInPandas(tidied(run), sent).withColumns({n: F.col(f"`{n}`").cast("long") for n in names})


def fresh_name(name: str, taken: list[str]) -> str:
    """``name``, with as many strokes behind it as make it unlike any column's name."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def shielded(docs: DataFrame, *known: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with neutral names for all but the ``known`` columns, and the way back.

    An operator can then add columns of any name; the second result restores the
    names and the order of ``docs`` on what the operator returns.
    """
    inner = [c if c in known else f"own_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*inner), lambda out: out.select(*inner).toDF(*docs.columns)


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from; false where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def seeded(doc_id: Column, seed: int) -> Column:
    """Repeatable pseudo-random long of an id."""
    return F.xxhash64(F.lit(seed), doc_id)


def unit_hash(doc_id: Column, seed: int) -> Column:
    """The same as a number from 0 to 1."""
    return F.shiftrightunsigned(seeded(doc_id, seed), 11) / F.lit(float(1 << 53))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_pieces(texts: list, limit: int) -> Iterator[slice]:
    """Slices of ``texts`` of about ``limit`` characters; a longer text stands alone."""
    start = held = 0
    for i, text in enumerate(texts):
        size = len(text)
        if i > start and held + size > limit:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(texts):
        yield slice(start, len(texts))
