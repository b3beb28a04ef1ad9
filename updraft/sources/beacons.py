"""Raw beacon log: reading, compacting, and parsing of radio lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "ts_recv STRING, raw STRING"
FEET_M = 0.3048
FPM_MS = 0.00508
KNOT_KMH = 1.852

# The public text form of a position packet, as one anchored pattern:
# sender, path, optional time, latitude, longitude, then the comment part.
POSITION = (
    r"^([^>]+)>[^:]*:(?:/(\d{2})(\d{2})(\d{2})h|!)"
    r"(\d{2})(\d{2}\.\d{2})([NS])(.)(\d{3})(\d{2}\.\d{2})([EW])(.)(.*)$"
)
IDENT = r"\bid([0-9A-Fa-f]{2})[0-9A-Fa-f]{6}"


def receive_time(log: DataFrame) -> DataFrame:
    """Types the receive time and its day; both are null without a usable one."""
    usable = F.when(F.length("ts_recv") >= 13, F.try_to_timestamp("ts_recv"))
    # Parsed once per row, not once per later use (see parse_beacons).
    return log.withColumn("ts_recv", F.explode(F.array(usable))).withColumn("day", F.to_date("ts_recv"))


def with_receive_time(log: DataFrame) -> DataFrame:
    """The same without the rows that have no usable time.

    A malformed JSON line reads as nulls and goes with them.
    """
    return receive_time(log.where(F.col("raw").isNotNull())).where(F.col("ts_recv").isNotNull())


def read_beacon_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows ``ts_recv, raw, day`` of gz or plain JSON-lines logs.

    Bad lines are dropped. A file that cannot be read to its end fails the
    query; :func:`read_damaged_log` takes what such files still hold.
    """
    return with_receive_time(spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE").json(paths))


def read_damaged_log(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """The log of files whose end may be cut off, and what each file gave.

    The second frame has one row per file: ``path, bytes, n_lines``. A file cut in
    its first block has no line; compare ``n_lines`` with what was written.
    """
    reader = spark.read.schema(LOG_SCHEMA).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", "true")
    lines = reader.json(paths).select("*", F.col("_metadata.file_path").alias("path"))
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"))
    # Both spell the scheme differently; the part after it is the same.
    plain = F.regexp_replace("path", "^file:/+", "/")
    counts = lines.groupBy(plain.alias("path")).agg(F.count("*").alias("n_lines"))
    given = files.withColumn("path", plain).join(counts, "path", "left").fillna(0, subset=["n_lines"])
    return with_receive_time(lines.drop("path")), given


def compact_beacon_log(log: DataFrame, path: str, files_per_hour: int = 4) -> None:
    """Rewrites the log as parquet by day, replacing only the days present.

    Day files in gz cannot be split; afterwards a busy hour is spread over
    ``files_per_hour`` files, each in receive order.
    """
    spread = F.pmod(F.xxhash64("raw"), F.lit(files_per_hour))
    placed = log.repartition("day", F.hour("ts_recv"), spread).sortWithinPartitions("day", "ts_recv")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_compacted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ts_recv TIMESTAMP, raw STRING, day DATE").parquet(path)


def _after(text: Column, mark: str, skip: int, length: int) -> Column:
    """Number in the ``length`` characters that follow a mark, null without it.

    Plain string functions: comment fields have fixed widths, and patterns cost
    several times as much per line.
    """
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + F.lit(len(mark) + skip), F.lit(length)).try_cast("double"))


def _course_speed(text: Column) -> tuple[Column, Column]:
    present = F.substring(text, 4, 1) == "/"
    return (
        F.when(present, F.substring(text, 1, 3).try_cast("double")),
        F.when(present, F.substring(text, 5, 3).try_cast("double")),
    )


def _climb_fpm(text: Column) -> Column:
    """Signed number right before ``fpm``."""
    word = F.substring_index(F.substring_index(text, "fpm", 1), " ", -1)
    return F.when(F.instr(text, "fpm") > 0, word.try_cast("double"))


def sender(raw: Column) -> Column:
    """Sender id of a packet, null for comments and lines without ``>``."""
    at = F.instr(raw, ">")
    return F.when((at > 1) & ~raw.startswith("#"), F.substring(raw, F.lit(1), at - 1))


def heard_by(raw: Column) -> Column:
    """Receiver that passed a packet on: the last station of its path."""
    path = F.substring_index(F.substring_index(raw, ":", 1), ">", -1)
    return F.substring_index(path, ",", -1)


def parse_beacons(log: DataFrame) -> DataFrame:
    """Radio lines to observations, all in native column expressions.

    ``kind`` is ``position``, ``receiver``, ``status`` or ``other``. Fields a
    line does not carry are null.
    """
    raw = F.col("raw")
    # Groups 2 to 13 joined by a character no packet contains: one evaluation
    # of the pattern per line instead of one per field.
    joined = "\u0001".join(f"${i}" for i in range(2, 14))
    split = F.split(F.regexp_replace(raw, POSITION, joined), "\u0001", 12)
    # The explode of a one-element array keeps the optimizer from copying the
    # pattern into every later filter and column that reads a part of it.
    fields = log.withColumn("_s", F.explode(F.array(split))).withColumn("_p", F.when(F.size("_s") == 12, F.col("_s")))
    hit = F.col("_p").isNotNull()

    def piece(i: int) -> Column:
        return F.col("_p")[i - 2]

    def signed(angle: Column, mark: Column, negative: str) -> Column:
        return angle * F.when(mark == negative, -1.0).otherwise(1.0)

    rest = piece(13)
    extra_lat = F.coalesce(_after(rest, "!W", 0, 1), F.lit(0.0))
    extra_lon = F.coalesce(_after(rest, "!W", 1, 1), F.lit(0.0))

    def angle(degrees: Column, minutes: Column, extra: Column) -> Column:
        # Whole thousandths of a minute, divided once: the double next to what the line says,
        # so a point on a border lies on it.
        # ``rint`` and not ``round``, which writes each double as a decimal text.
        return (degrees.cast("double") * 60_000 + F.rint(minutes.cast("double") * 1_000) + extra) / 60_000

    lat, lon = angle(piece(5), piece(6), extra_lat), angle(piece(9), piece(10), extra_lon)
    flags = F.conv(F.nullif(F.regexp_extract(rest, IDENT, 1), F.lit("")), 16, 10).cast("int")
    receiver = piece(12) == "&"
    kind = (
        F.when(hit & receiver, "receiver")
        .when(hit, "position")
        .when(raw.rlike(r"^[^>#]+>[^:]*:>"), "status")
        .otherwise("other")
    )
    values = F.struct(
        sender(raw).alias("source_id"),
        kind.alias("kind"),
        F.shiftright(flags, 2).bitwiseAND(F.lit(15)).alias("aircraft_type"),
        piece(2).try_cast("int").alias("packet_h"),
        piece(3).try_cast("int").alias("packet_m"),
        piece(4).try_cast("int").alias("packet_s"),
        signed(lat, piece(7), "S").alias("lat"),
        signed(lon, piece(11), "W").alias("lon"),
        (_after(rest, "/A=", 0, 6) * FEET_M).alias("alt_m"),
        rest.alias("_rest"),
    )
    # Again one explode: later filters test finished fields. What it makes is never pruned and all of it is one
    # method, which the JVM leaves uncompiled beyond 8000 bytes; so fields that few want come after it.
    finished = fields.select("day", "ts_recv", "raw", F.inline(F.array(values)))
    course, speed = _course_speed(F.col("_rest"))
    return finished.select(
        *[c for c in finished.columns if c != "_rest"],
        (_climb_fpm(F.col("_rest")) * FPM_MS).alias("climb_ms"),
        (speed * KNOT_KMH).alias("speed_kmh"),
        course.alias("course_deg"),
    )


def gps_timestamp(parsed: DataFrame, midnight_fix: bool = False) -> DataFrame:
    """Adds ``gps_ts``: packet time of day on the receive date.

    Packets without a time use the receive second. ``midnight_fix`` moves a time
    more than 12 hours off the receive time to the neighbouring day.
    """
    # Sums of whole seconds: a timestamp made from six fields costs more than parsing the line.
    h, m, sec = (F.col(f"packet_{c}").cast("long") for c in "hms")
    valid = h.between(0, 23) & m.between(0, 59) & sec.between(0, 60)
    of_day = F.when(valid, h * 3600 + m * 60 + sec)
    on_day = F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", "ts_recv")) + of_day)
    if midnight_fix:
        off = F.unix_timestamp(on_day) - F.unix_timestamp("ts_recv")
        day = F.make_dt_interval(days=F.lit(1))
        on_day = F.when(off > 43_200, on_day - day).when(off < -43_200, on_day + day).otherwise(on_day)
    return parsed.withColumn("gps_ts", F.coalesce(on_day, F.date_trunc("second", "ts_recv")))


def observations(parsed: DataFrame, midnight_fix: bool = False) -> DataFrame:
    """Parsed rows with ``gps_ts`` and its second ``t_s``, as the track operators want.

    ``day`` is the day of the log, that is of receipt.
    """
    timed = gps_timestamp(parsed, midnight_fix)
    return timed.withColumn("t_s", F.unix_timestamp("gps_ts"))
