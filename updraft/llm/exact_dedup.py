"""Exact duplicates through an extendible-hash index on shared files.

A text's 64-bit hash is its key. The directory doubles, one key bit at a time,
until no bucket holds more than ``page_keys`` distinct keys; copies share a key
and can never overfill a bucket. Copies merge into a bounded number of shares
where they are read. The directory then routes each share to its bucket, a range
of keys with one owner task. The owner compares the bytes of the texts that meet
in one key, adds up the shares of equal ones and chains different ones. Its pages
are written to the shared folder. Everything is DataFrame work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from updraft.llm.common import SPACE, cut_lineage, shielded
from updraft.session import broadcast_if_small

PAGE_KEYS = 4096
KEY_BITS = 64
#: Rows in which the copies of one text reach its owner at most.
SHARES = 32


def normalised(text: Column) -> Column:
    """Null counts as empty; every run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def key_of(body: Column) -> Column:
    return F.xxhash64(body)


def prefix(key: Column, bits: int) -> Column:
    """The leading bits of a key as a number."""
    return F.shiftrightunsigned(key, KEY_BITS - bits) if bits else F.lit(0).cast("long")


@dataclass
class Index:
    """``pages`` (bucket, key, chain, sha, keep_id, size) and ``directory`` (slot, depth, bucket)."""

    pages: DataFrame
    directory: DataFrame
    bits: int


def directory(keys: DataFrame, page_keys: int = PAGE_KEYS) -> tuple[DataFrame, int]:
    """The settled directory (slot, depth, bucket) of distinct keys and the bits of its slots.

    A slot belongs to the shallowest bucket on its path that is not overfull,
    which is where doubling stops. Slots that are overfull at full depth make
    the directory deeper and the count is taken again.
    """
    bits = min(KEY_BITS - 1, max(0, (keys.count() // page_keys).bit_length()) + 2)
    while True:
        slots = keys.groupBy(prefix(F.col("key"), bits).alias("slot")).agg(F.count("*").alias("n"))
        slots = cut_lineage(slots, "slots")
        if bits == KEY_BITS - 1 or slots.where(F.col("n") > page_keys).isEmpty():
            break
        bits = min(KEY_BITS - 1, bits + 4)
    path = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")
    on_path = slots.select("slot", "n", path).withColumn("head", F.expr(f"shiftrightunsigned(slot, {bits} - depth)"))
    fill = on_path.groupBy("depth", "head").agg(F.sum("n").alias("fill"))
    room = (F.col("fill") <= page_keys) | (F.col("depth") == bits)
    settled = on_path.join(fill, ["depth", "head"]).where(room).groupBy("slot").agg(F.min("depth").alias("depth"))
    start = F.expr(f"shiftleft(shiftrightunsigned(slot, {bits} - depth), {bits} - depth)")
    return settled.withColumn("bucket", start), bits


def build_index(docs: DataFrame, page_keys: int = PAGE_KEYS) -> Index:
    """Index over ``docs`` (doc_id, text).

    An input partition belongs to one share, so a group of copies sends one row per
    partition, and its owner gets one row per share. Both merges compare whole texts.
    A bucket has a bounded number of keys and hence of rows.
    """
    body = normalised(F.col("text")).alias("body")
    keyed = docs.select("doc_id", body).withColumn("key", key_of(F.col("body")))
    slots, bits = directory(cut_lineage(keyed.select("key").distinct(), "keys"), page_keys)
    slots = cut_lineage(slots, "directory")
    share = F.pmod(F.spark_partition_id(), F.lit(SHARES))
    shares = keyed.withColumn("share", share).groupBy("share", "key", "body")
    shares = shares.agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("size"))
    routed = shares.withColumn("slot", prefix(F.col("key"), bits)).join(broadcast_if_small(slots.select("slot", "bucket")), "slot")
    # Grouping and chaining reuse the partitions by bucket: the owner needs no further shuffle.
    owned = routed.repartition("bucket").groupBy("bucket", "key", "body")
    entries = owned.agg(F.min("keep_id").alias("keep_id"), F.sum("size").alias("size"))
    entries = entries.withColumn("sha", F.sha2("body", 256)).drop("body")
    chain = Window.partitionBy("bucket", "key").orderBy("sha")
    pages = entries.withColumn("chain", F.row_number().over(chain))
    pages = pages.select("bucket", "key", "chain", "sha", "keep_id", "size")
    return Index(cut_lineage(pages, "pages"), slots, bits)


def probe(docs: DataFrame, index: Index) -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to every row of ``docs``.

    Only entries that their owner found to have copies take part in the join; every
    other text is its own group. The digest tells the links of a chain apart.
    """
    body = normalised(F.col("text"))
    whole = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    own, _ = shielded(whole, "doc_id", "text")
    keyed = own.withColumn("_key", key_of(body)).withColumn("text_sha256", F.sha2(body, 256))
    shared = index.pages.where("size > 1").select(
        F.col("key").alias("_key"), F.col("sha").alias("text_sha256"), F.col("keep_id").alias("_keep"), F.col("size").alias("_size")
    )
    found = keyed.join(shared, ["_key", "text_sha256"], "left")
    keep = F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    found = found.select(
        *own.columns,
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
    return found.toDF(*whole.columns, *found.columns[len(whole.columns) :])


def exact_dedup(docs: DataFrame, page_keys: int = PAGE_KEYS) -> DataFrame:
    """Every row with the row that stays of its group of equal texts.

    Null and empty texts are equal. Ids that are null never win over others; a
    group of null ids only has a null ``keep_id`` and keeps its rows. Repeated
    rows with one id and text are one document and share its verdict (see
    :func:`deduplicated`). An empty table gives an empty result. Further columns
    pass through, except those named like the result's own.
    """
    return probe(docs, build_index(docs, page_keys))


def deduplicated(docs: DataFrame, page_keys: int = PAGE_KEYS) -> DataFrame:
    """The rows that stay, one for each text, with the columns of ``docs``, whatever their names.

    Null and empty texts are one group. An id that is null stays only where its
    group has no other. An empty table stays empty.
    """
    plain, restored = shielded(docs, "doc_id", "text")
    return restored(exact_dedup(plain, page_keys).where("kept").dropDuplicates(["text_sha256"]))


VERDICT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")

#: The same in SQL.
SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
