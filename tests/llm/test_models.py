"""Language and quality models: held-out accuracy, methods on small cases, edge rows."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from updraft.llm import language_id as li
from updraft.llm import quality
from updraft.llm.common import held_out, table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, held_out string"


def edge_docs(spark):
    rows = [
        (1, None, "en"), (2, "", "en"), (3, "123 ... !", "en"), (None, "words without an id", "en"), (4, "the the words", None),
        (5, "x" * 700_000 + " the end", "en"), (6, "the cat and the dog", "en"), (6, "the cat and the dog", "en"), (7, "le chat et le chien", "fr"),
        (8, "\U0001f600 und 漢字", "xx"), (9, "le petit chat", "fr"), (12, "the small cat", "en"),
    ]
    return spark.createDataFrame([(*r, "s", 1, "x", "y") for r in rows], DOCS)


def test_held_out_fold(spark):
    got = {r.id: r.h for r in spark.range(300).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(300)}


def test_languages_held_out(spark):
    docs = table(spark, SF, "documents")
    rows = li.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 250
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_rows(spark):
    docs = edge_docs(spark)
    got = li.predicted(docs).collect()
    assert len(got) == 12 and got[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by_id[3].score == 0
    assert {r.lang_pred for r in got} <= {"und", "en", "fr", "xx"} and by_id[None].held_out is False
    assert li.predicted(docs.limit(0)).collect() == []
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in li.predicted(nothing).collect()} == {"und"}


def test_predictions_ignore_held_out_labels(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    spoiled = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(li.predicted(docs).collect()) == sorted(li.predicted(spoiled).collect())


def test_leader_is_sparse_and_right():
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(2000, 30, replace=False)), np.ones(30)) for _ in range(600)]
    target = np.array([int((b < 1000).mean() > 0.5) for b, _ in rows])
    weights, bias = li.fit_leader(rows, target, 2)
    scores = np.array([v @ weights[b] + bias for b, v in rows])
    assert (scores.argmax(axis=1) == target).mean() > 0.95
    assert (weights[2000:] == 0).all()


def test_temperature_recovers_the_scale():
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(20_000, 3))
    chances = li._softmax(scores)
    target = np.array([rng.choice(3, p=p) for p in chances])
    assert math.isclose(li.fit_temperature(scores * 3, target), 3, rel_tol=0.1)
    assert li.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_quality_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.scored(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 90
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all((r.predicted == 1) == (r.score >= 0.5) for r in rows)


def test_risk_never_rewards_a_negative_estimate():
    rng = np.random.default_rng(6)
    good = rng.normal(size=(40, 8)) + 2
    web = np.vstack([rng.normal(size=(170, 8)) + 2, rng.normal(size=(30, 8)) - 2])
    model = quality.fit_risk(np.vstack([good, web]), np.arange(240) < 40, 0.85)
    right = (web @ model.weights + model.bias >= 0) == (np.arange(200) < 170)
    assert right.mean() > 0.97 and np.isfinite(model.weights).all()


@pytest.mark.parametrize("values", [[(1, 1), (2, 0), (6, 1), (6, 0), (None, 1), (7, None), (9, 5)], [(1, 1)], []])
def test_quality_edge_rows(spark, values):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(*v, 0) for v in values], "doc_id long, quality int, toxic int")
    rows = quality.scored(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert quality.good_documents(docs, labels).columns == docs.columns
    assert quality.scored(docs.limit(0), quality.fit(docs.limit(0), labels)).collect() == []


def test_quality_ignores_held_out_labels(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    spoiled = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.scored(docs, quality.fit(docs, x)).select("doc_id", "score").collect() for x in (labels, spoiled))
    assert sorted(a) == sorted(b)


def test_signs_that_are_no_letters():
    from updraft.llm.language_id import has_letter

    assert not any(map(has_letter, ["", " ", "² ½ ①", "Ⅷ", "12_3", "—"])) and all(map(has_letter, ["² é", "ª", "中", "1a"]))
