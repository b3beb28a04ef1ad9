"""Corpus preparation in five stages, each one of the training-data operators.

A stage takes ``(spark, docs, sf_dir)`` and returns what it keeps; its result is
written as Parquet in the shared folder and read again as the next stage's docs.
All stages but the last return the columns of their docs, whatever their names; an
empty table gives an empty result, and null texts, ids, sources and repeated rows
are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from updraft.llm import exact_dedup as exact
from updraft.llm import minhash_dedup as near
from updraft.llm import mixing, packing, quality
from updraft.llm.common import cut_lineage, ship, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    return near.deduplicated(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a document may come whole, in part, twice or not at all."""
    ship(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces of token sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing to target weights", target_mix),
    ("packing", packed),
]

#: A trained score and a tokenizer have no SQL twin; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
