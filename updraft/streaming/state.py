"""Merged partial results of a stream: deltas, compaction, one manifest per run.

A batch writes one delta, its own partial results by bucket (mostly a day), and
then replaces the manifest, a small file that names what counts. After some deltas
the buckets that they touch, and no others, are merged into new bases. The cost of
a batch follows the batch and the buckets it touches, not what came before.

A run is what one checkpoint has seen. Its id lies in the checkpoint's folder and
names the folder of its state, so a new checkpoint starts from nothing and an old
one goes on from its own state; the table shows the run that was started last. A
batch that is repeated after a failure overwrites its delta, or is left out if
the manifest has it already. Files that no manifest names do not count.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Deltas after which their buckets are merged.
COMPACT_AFTER = 12
_BUCKET = "_bucket"


@dataclass(frozen=True)
class Merged:
    """``partial`` turns a batch into rows per key, ``merge`` unites such rows; equal keys have one ``bucket`` (SQL)."""

    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    bucket: str


@dataclass
class Manifest:
    epoch: int = -1
    schema: str | None = None
    deltas: list[str] = field(default_factory=list)
    bases: dict[str, str] = field(default_factory=dict)
    #: Folders that the last compaction replaced; the next one removes them.
    replaced: list[str] = field(default_factory=list)


# -- small files in the shared folder ----------------------------------------


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    target, store = _hadoop(spark, path)
    if not store.exists(target):
        return None
    source = store.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Readers see the old text or the new one, never a part."""
    fresh, store = _hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    out = store.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs = spark._jvm.org.apache.hadoop.fs
    kind = getattr(fs, "Options$Rename")
    over = spark._sc._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    target = fs.Path(path)
    fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, target, over)


def _remove(spark: SparkSession, path: str) -> None:
    target, store = _hadoop(spark, path)
    store.delete(target, True)


# -- a run's state -----------------------------------------------------------


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """Id of the checkpoint's run; a new checkpoint gets a new one."""
    place = f"{checkpoint}/state-run"
    known = read_text(spark, place)
    if known:
        return known
    offsets, store = _hadoop(spark, f"{checkpoint}/offsets")
    if store.exists(offsets):
        raise ValueError(f"checkpoint {checkpoint} has read input for a state that is not here")
    fresh = uuid.uuid4().hex
    replace_text(spark, place, fresh)
    return fresh


def manifest(spark: SparkSession, root: str) -> Manifest:
    text = read_text(spark, f"{root}/manifest.json")
    return Manifest(**json.loads(text)) if text else Manifest()


def commit(spark: SparkSession, root: str, now: Manifest) -> None:
    replace_text(spark, f"{root}/manifest.json", json.dumps(asdict(now)))


def _named(bucket: str) -> Column:
    return F.coalesce(F.expr(bucket).cast("string"), F.lit("none"))


def _rows(spark: SparkSession, root: str, schema: StructType, deltas: list[str], bases: dict[str, str]) -> DataFrame:
    paths = [f"{root}/{d}" for d in deltas] + [f"{root}/{folder}/{_BUCKET}={b}" for b, folder in bases.items()]
    if not paths:
        return spark.createDataFrame([], schema)
    # One reader for each kind: a delta has bucket folders below it, a base path is one.
    parts = [spark.read.schema(schema).option("basePath", root).parquet(*some).select(*schema.names) for some in (paths[: len(deltas)], paths[len(deltas) :]) if some]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def add_delta(spark: SparkSession, root: str, rows: DataFrame, bucket: str, epoch: int) -> None:
    """Makes the batch's rows count, once however often it is repeated."""
    now = manifest(spark, root)
    if epoch <= now.epoch:
        return
    folder = f"delta={epoch:010d}"
    rows.withColumn(_BUCKET, _named(bucket)).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{root}/{folder}")
    now.epoch, now.schema = epoch, rows.schema.json()
    now.deltas.append(folder)
    commit(spark, root, now)


def compact(spark: SparkSession, root: str, merge: Callable[[DataFrame], DataFrame], bucket: str) -> None:
    """Merges the deltas into the buckets that they touch."""
    now = manifest(spark, root)
    if not now.deltas:
        return
    schema = StructType.fromJson(json.loads(now.schema))
    # As many values as days that the deltas reach.
    deltas = _rows(spark, root, schema, now.deltas, {})
    touched = [r[0] for r in deltas.select(_named(bucket)).distinct().collect()]
    old = {b: now.bases[b] for b in touched if b in now.bases}
    folder = f"base={now.epoch:010d}"
    merged = merge(_rows(spark, root, schema, now.deltas, old)).withColumn(_BUCKET, _named(bucket))
    merged.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{root}/{folder}")
    obsolete = now.replaced
    now.replaced = now.deltas + [f"{f}/{_BUCKET}={b}" for b, f in old.items()]
    now.bases |= dict.fromkeys(touched, folder)
    now.deltas = []
    commit(spark, root, now)
    # A reader that began before the last commit but one is long done.
    for name in obsolete:
        _remove(spark, f"{root}/{name}")


def run_merged(stream: DataFrame, path: str, checkpoint: str, state: Merged) -> None:
    """Drains the available input into the state of the checkpoint's run."""
    spark = stream.sparkSession
    run = run_of(spark, checkpoint)
    root = f"{path}/run-{run}"
    replace_text(spark, f"{path}/current", run)

    def save(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        add_delta(session, root, state.partial(batch), state.bucket, epoch)
        if len(manifest(session, root).deltas) >= COMPACT_AFTER:
            compact(session, root, state.merge, state.bucket)

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def merged_rows(spark: SparkSession, path: str, state: Merged, schema: str | None = None) -> DataFrame:
    """The rows of the run started last; ``schema`` serves while no batch has come."""
    run = read_text(spark, f"{path}/current")
    root = f"{path}/run-{run}"
    now = manifest(spark, root) if run else Manifest()
    if now.schema is None:
        return spark.createDataFrame([], schema)
    kinds = StructType.fromJson(json.loads(now.schema))
    return state.merge(_rows(spark, root, kinds, now.deltas, now.bases))
