"""The registered queries: each operator over its whole table, with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from updraft.llm import alignment, byte_bpe, embedding_dedup, exact_dedup, html_extract, language_id, minhash_dedup, mixing, packing, quality, secret_scan, token_files, vector_codes
from updraft.llm.common import table

#: Word shingles of the near-duplicate query.
QUERY_SHINGLE_WORDS = 4


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted(table(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*exact_dedup.VERDICT)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_components(table(spark, sf_dir, "documents"), QUERY_SHINGLE_WORDS)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", "held_out", "score", "predicted")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_embedding_dedup, op2_mixing, op3_language_id, op4_html_extract, op5_packing,
    op6_token_output, op7_secrets, op8_exact_dedup, op9_minhash_dedup, op10_quality,
    op11_byte_bpe, op12_vector_codes, op13_alignment,
)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLES = {"op1_embedding_dedup": embedding_dedup.SQL, "op8_exact_dedup": exact_dedup.SQL, "op12_vector_codes": vector_codes.SQL}
