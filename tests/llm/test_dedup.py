"""Exact and near duplicates."""

from __future__ import annotations

import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from updraft.llm import exact_dedup, minhash_dedup
from updraft.llm.common import table
from updraft.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark):
    long_text = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    rows = [
        (1, "a  b\tc", None, "s", 1), (2, "a b c", "en", None, 5), (3, None, "en", "s", 0), (4, "", "en", "s", 0),
        (5, " ", "en", "s", 1), (6, "A b c d e", "en", "s", 9), (7, "a B c d e", "en", "s", 9), (8, long_text, "en", "s", 9),
        (9, long_text + " tail", "en", "s", 9), (10, "x", "en", "s", 1), (10, "x", "en", "s", 1), (None, "lonely", "en", "s", 1),
        (None, "x", "en", "s", 1), (11, "a b c", "en", "s", 5),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_exact_groups(spark):
    rows = exact_dedup.exact_dedup(edge_docs(spark)).collect()
    got = {(r.doc_id, r.text): (r.keep_id, r.group_size, r.kept) for r in rows}
    assert len(rows) == 14
    assert got[1, "a  b\tc"] == (1, 3, True) and got[11, "a b c"] == (1, 3, False)
    assert got[3, None] == (3, 2, True) and got[4, ""] == (3, 2, False)
    assert got[5, " "] == (5, 1, True)
    assert got[10, "x"] == (10, 3, True) and got[None, "x"] == (10, 3, False)
    assert got[None, "lonely"] == (None, 1, True)


def test_exact_keeps_one_row_per_text(spark):
    docs = edge_docs(spark).selectExpr("*", "1 AS kept", "2 AS keep_id")
    assert "keep_id" in exact_dedup.exact_dedup(docs).columns
    kept = exact_dedup.deduplicated(edge_docs(spark))
    assert kept.count() == 9 and kept.columns == edge_docs(spark).columns


def test_directory_doubles(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id % 700) AS text")
    index = exact_dedup.build_index(docs, page_keys=20)
    slots = index.directory.join(
        index.pages.selectExpr("key", f"shiftrightunsigned(key, {64 - index.bits}) AS slot"), "slot"
    )
    fill = [r["count"] for r in slots.groupBy("bucket").count().collect()]
    assert sum(fill) == 700 and max(fill) <= 20 and len(fill) > 35
    assert exact_dedup.probe(docs, index).where("kept").count() == 700


def test_chains_tell_texts_with_one_key_apart(spark):
    docs = spark.createDataFrame([(1, "p"), (2, "q"), (3, "p")], "doc_id long, text string")
    index = exact_dedup.build_index(docs)
    same = index.pages.selectExpr("bucket", "7L AS key", "chain", "sha", "keep_id", "size")
    assert same.select("sha").distinct().count() == 2
    assert {r.keep_id for r in exact_dedup.probe(docs, index).collect()} == {1, 2}


def test_owners_compare_texts_whose_keys_are_equal(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "key_of", lambda body: F.length(body).cast("long"))
    docs = spark.range(0, 600, 1, 8).selectExpr("id AS doc_id", "concat('t', lpad(id % 7, id % 3 + 1, '0')) AS text")
    index = exact_dedup.build_index(docs)
    assert sorted((r.key, r.chain) for r in index.pages.collect()) == [(n, c) for n in (2, 3, 4) for c in range(1, 8)]
    want = {(r.doc_id, r.text) for r in docs.collect()}
    first, size = {}, Counter()
    for doc_id, text in sorted(want):
        first.setdefault(text, doc_id)
        size[text] += 1
    got = {(r.doc_id, r.text): (r.keep_id, r.group_size) for r in exact_dedup.probe(docs, index).collect()}
    assert got == {(d, t): (first[t], size[t]) for d, t in want}


def test_groups_come_from_the_owners_that_the_directory_names(spark, monkeypatch):
    real = exact_dedup.directory
    docs = spark.range(0, 400, 1, 8).selectExpr("id AS doc_id", "concat('text ', id % 100) AS text")

    def without_half(keys, page_keys):
        slots, bits = real(keys, page_keys)
        return slots.where(f"slot >= {1 << bits - 1}"), bits

    assert {r.group_size for r in exact_dedup.exact_dedup(docs).collect()} == {4}
    monkeypatch.setattr(exact_dedup, "directory", without_half)
    sizes = Counter(r.group_size for r in exact_dedup.exact_dedup(docs).collect())
    assert set(sizes) == {1, 4} and sum(sizes.values()) == 400


def test_shares_of_a_group_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARES", 3)
    docs = spark.range(0, 500, 1, 40).selectExpr("id AS doc_id", "if(id % 2 = 0, 'hot', concat('t', id)) AS text")
    rows = exact_dedup.exact_dedup(docs).where("text = 'hot'").collect()
    assert {(r.keep_id, r.group_size) for r in rows} == {(0, 250)} and sum(r.kept for r in rows) == 1


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, minhash_dedup.near_components])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], DOCS)).collect() == []


def test_shingle_sets_match_words():
    texts = ["A b  c d", "a B c\nd e", None, "", "one", "ONE", "é É", "a b c d e f g h"]
    for width in (2, 4, 5):
        sets = shingle_sets(texts, width)
        for i, a in enumerate(texts):
            assert len(sets[i]) == len(brute.shingles(a, width))
            for j, b in enumerate(texts):
                both = len(brute.shingles(a, width) & brute.shingles(b, width))
                assert len(set(sets[i].tolist()) & set(sets[j].tolist())) == both


def test_near_edge_rows(spark):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash_dedup.near_components(edge_docs(spark), 4).collect()}
    assert got[7, 2] == (6, False) and got[11, 1] == (1, False)
    assert got[3, 0] == (3, True) and got[4, 0] == (4, True)
    assert got[9, len(brute.shingles(edge_docs(spark).where("doc_id = 9").first().text, 4))] == (8, False)
    assert got[None, 1] == (None, True)


def _near_family(rng, start, size, words=60, edits=2):
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    for i in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield start + i, " ".join(own)


def test_near_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [r for k in range(25) for r in _near_family(rng, 1000 * k, 12, words=rng.choice([30, 60, 120]), edits=rng.choice([1, 2, 3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_components(docs, 4).collect()}
    want = brute.near_components(rows, 4)
    assert got == want
    assert len({c for _, c in want.values()}) > 25


def test_near_matches_brute_force_on_the_table(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_components(docs).collect()}
    assert got == brute.near_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 5)
    assert minhash_dedup.deduplicated(docs).count() == sum(d == c for d, (_, c) in got.items())


def test_ids_with_several_texts_are_one_document(spark):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    text, other, third = words(40), words(40), words(40)
    rows = [(1, other), (1, text), (2, text), (3, other), (4, [*text, "more"]), (5, third), (5, [*other, "tail"]), (6, [*third, "end"]), (7, words(40)), (8, words(9))]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in minhash_dedup.near_components(docs, 4).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 7), (8, 8)}
    assert sorted(r.doc_id for r in minhash_dedup.deduplicated(docs.selectExpr("*", "'x' AS kept_id", "1 AS component_id")).collect()) == [1, 1, 7, 8]


def test_many_variants_that_are_just_too_different(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "ENTRY_BLOCK", 16)
    monkeypatch.setattr(minhash_dedup, "CLUSTER_BLOCK", 20)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(150):
        own = list(base)
        for k in rng.sample(range(100), 5 if i % 3 else 3):
            own[k] = f"e{rng.randrange(60)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_components(docs, 4).collect()}
    assert got == brute.near_components(rows, 4)


def test_long_words_of_few_letters_differ():
    words = ["a", "b"]
    for _ in range(10):
        words = [words[0] + words[1], words[1] + words[0]]
    assert len({int(s[0]) for s in shingle_sets(words, 4)}) == 2
    assert len({int(s[0]) for s in shingle_sets([words[0], words[0].upper()], 4)}) == 1
