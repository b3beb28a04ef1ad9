"""Derived tables: clean fixes, phases, grids, manifests, series, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = """
seq BIGINT, init_utc STRING, tier STRING, finished_utc STRING, files_attempted INT, files_ok INT, files_404 INT,
files_error INT, bytes_on_disk BIGINT, variables ARRAY<STRING>,
trigger STRUCT<fire: BOOLEAN, reason: STRING, metrics: STRUCT<cape_cover_frac: DOUBLE, rad_cover_frac: DOUBLE,
  htop_dc_cover_frac: DOUBLE, wet_frac: DOUBLE, cape_max_jkg: DOUBLE>>,
decision_init_utc STRING, errors ARRAY<STRING>
"""
HEARTBEAT_SCHEMA = """
job STRING, last_attempt_utc STRING, last_status STRING, since_utc STRING, last_success_utc STRING,
last_extra MAP<STRING, STRING>
"""
WATCHLIST_SCHEMA = "name STRING, ogn_name STRING, note STRING"


def _overwrite_partitions(df: DataFrame, path: str, *keys: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_clean_fixes(fixes: DataFrame, path: str) -> None:
    """Clean layer by day, clustered by aircraft so single-aircraft reads skip row groups.

    The rebalance makes as many files as the rows need: no day is bound to a number
    of tasks, and a large one is split further at run time.
    """
    placed = fixes.hint("rebalance", "day", "source_id").sortWithinPartitions("day", "source_id", "t_s")
    _overwrite_partitions(placed, path, "day")


def read_clean_fixes(spark: SparkSession, path: str, day=None, source_id=None) -> DataFrame:
    """Clean fixes; day prunes folders and the aircraft is pushed to parquet."""
    fixes = spark.read.parquet(path)
    if day is not None:
        fixes = fixes.where(F.col("day") == day)
    if source_id is not None:
        fixes = fixes.where(F.col("source_id") == source_id)
    return fixes


def write_phases(phases: DataFrame, days: DataFrame, path: str, ledger_path: str, batch: str) -> None:
    """Phases by day plus a ledger row for every processed day, also empty ones.

    ``batch`` names this run. The ledger says which batch of a day counts, so a
    day done again without any phase does not keep its old ones. The counts come
    from the written table: detection runs once.
    """
    spark = phases.sparkSession
    stamped = phases.withColumn("batch", F.lit(batch))
    _overwrite_partitions(stamped, path, "day")
    done = days.select("day").distinct()
    written = spark.read.schema(stamped.schema).parquet(path).where(F.col("batch") == batch)
    counts = written.join(done, "day", "left_semi").groupBy("day").agg(F.count("*").alias("n_phases"))
    ledger = done.join(counts, "day", "left").select(
        "day", F.lit(batch).alias("batch"), F.coalesce("n_phases", F.lit(0)).alias("n_phases")
    )
    _overwrite_partitions(ledger, ledger_path, "day")


def read_phases(spark: SparkSession, path: str, ledger_path: str, schema=None) -> DataFrame:
    """Phases of each day's latest batch.

    With a ``schema`` the table may also be empty, as before the first phase.
    """
    ledger = spark.read.parquet(ledger_path).select("day", "batch")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).join(ledger, ["day", "batch"], "left_semi").drop("batch")


def upsert_grid(grid: DataFrame, path: str, run: str = "init_h") -> None:
    """Fields by variable and run; appending a run twice leaves it once."""
    placed = grid.repartition("var", run, F.col("lead_h")).sortWithinPartitions("var", run, "lead_h", "lat_i", "lon_i")
    _overwrite_partitions(placed, path, "var", run)


def append_manifest(records: DataFrame, path: str) -> None:
    """Appends records as JSON lines; null fields are left out."""
    records.write.mode("append").option("ignoreNullFields", "true").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records in a fixed nested schema, absent keys null, in append order."""
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


def read_heartbeats(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One state per job, by job name; unreadable or foreign files are skipped."""
    rows = spark.read.schema(HEARTBEAT_SCHEMA).option("multiLine", multi_line).json(path)
    return rows.dropna(subset=["job", "last_attempt_utc", "last_status", "since_utc"]).orderBy("job")


def read_watchlist(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Watch list entries that have a name and a sender id; the note defaults to ''."""
    rows = spark.read.schema(WATCHLIST_SCHEMA).option("multiLine", multi_line).json(path)
    return rows.dropna(subset=["name", "ogn_name"]).fillna("", subset=["note"])


def read_sounding_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line and ``#`` comments."""
    return spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)


def write_series(series: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """Result series per run, with where it came from as columns."""
    stamped = series.withColumns({k: F.lit(v) for k, v in provenance.items()})
    _overwrite_partitions(stamped, path, "init_h")


def file_inventory(spark: SparkSession, path: str, layer_pattern: str) -> DataFrame:
    """Files and bytes per layer; file contents are never read.

    ``layer_pattern`` is a regular expression whose first group names the layer
    in a path; files outside any layer are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    layer = F.regexp_extract("path", layer_pattern, 1)
    named = files.select(layer.alias("layer"), "length").where("layer <> ''")
    return named.groupBy("layer").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))


def last_bytes(inventory: DataFrame, n: int = 7) -> DataFrame:
    """Total bytes of the last ``n`` layers in name order."""
    newest = inventory.orderBy(F.desc("layer")).limit(n)
    return newest.agg(F.count("*").alias("n_layers"), F.sum("bytes").alias("bytes"))


def best_region_layer(candidates: DataFrame) -> DataFrame:
    """Of stacked layers with a ``priority``, the rows of the best one present.

    One aggregate finds the priority; no window over the whole table.
    """
    best = candidates.select(F.min("priority")).scalar()
    return candidates.where(F.col("priority") == best).drop("priority")


def newest_day(table: DataFrame, wanted=None) -> DataFrame:
    """Rows of the wanted day if present, else of the newest day."""
    newest = table.select(F.max("day")).scalar()
    if wanted is None:
        return table.where(F.col("day") == newest)
    asked = table.where(F.col("day") == wanted).select(F.max("day")).scalar()
    return table.where(F.col("day") == F.coalesce(asked, newest))
