"""Ids above 2**53 beside a null id come back as they were."""

from __future__ import annotations

from functools import partial
from types import SimpleNamespace

import numpy as np
import pytest

from updraft.llm import embedding_dedup, html_extract, language_id, minhash_dedup, mixing, packing, quality, secret_scan

BIG = 2**53 + 1
IDS = [None, BIG, BIG - 1, -BIG, 2**63 - 1]
TEXTS = [f"some words {i} password: abcdefgh and number {i} of the texts" for i in range(len(IDS))]


def half():
    class Half:  # local, so that it travels to the workers
        def extract(self, source):
            return "text"

    return Half()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, text, "web", d) for d, text in zip(IDS, TEXTS, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long").coalesce(1)


def pages(docs):
    return docs.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html")


def vectors(docs):
    return docs.selectExpr("doc_id AS vec_id", "CAST(coalesce(doc_id, 3) AS LONG) AS label", "array(1f, 2f) AS embedding")


@pytest.mark.parametrize("name, run", [
    ("doc_id", lambda d: language_id.predicted(d, SimpleNamespace(predict=dict.fromkeys(TEXTS, ("en", 0.5)).__getitem__))),
    ("page_id", lambda d: html_extract.main_text(pages(d), half())),
    ("doc_id", lambda d: packing.pack(d)),
    ("doc_id", lambda d: secret_scan.secret_spans(d)),
    ("size", lambda d: secret_scan.masked(d)),
    ("doc_id", lambda d: minhash_dedup.near_components(d, 2)),
    ("component_id", lambda d: minhash_dedup.near_components(d, 20)),
    ("size", lambda d: quality.scored(d, SimpleNamespace(score=partial(np.full_like, fill_value=0.5, dtype=float)))),
    ("vec_id", lambda d: embedding_dedup.embedding_links(vectors(d))),
    ("component_id", lambda d: embedding_dedup.embedding_links(vectors(d))),
])
def test_large_ids_beside_null(docs, name, run):
    assert {r[name] for r in run(docs).select(name).collect()} == set(IDS)


def test_mix_keeps_ids(docs):
    assert {r.doc_id for r in mixing.mixed_documents(docs).collect()} <= set(IDS)
