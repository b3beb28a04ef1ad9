"""Mixing: apportionment, targets and what the mix takes."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from updraft.llm import mixing
from updraft.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"


def plain_seats(votes, seats, most):
    out = [0] * len(votes)
    for _ in range(seats):
        best = max((v / (2 * s + 1), -i) for i, (v, s, m) in enumerate(zip(votes, out, most, strict=True)) if s < m and v > 0)
        out[-best[1]] += 1
    return out


@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 40)), min_size=1, max_size=12), st.integers(0, 200))
@settings(max_examples=200, deadline=None)
def test_apportion_by_highest_quotients(parties, seats):
    votes, most = (np.array(x, np.int64) for x in zip(*parties, strict=True))
    seats = min(seats, int(most[votes > 0].sum()))
    assert mixing.apportion(votes, seats, most).tolist() == plain_seats(votes, seats, most)


def plain_targets(sizes, weights):
    """Reshares the excess round by round."""
    goal, left, free = [0.0] * len(sizes), 1.5 * sum(sizes), set(range(len(sizes)))
    while left > 1e-9 and free:
        total = sum(weights[i] for i in free)
        part = {i: left * weights[i] / total for i in free}
        left = 0.0
        for i, p in part.items():
            goal[i] += p
            if goal[i] >= 2 * sizes[i]:
                left += goal[i] - 2 * sizes[i]
                goal[i] = 2.0 * sizes[i]
                free.discard(i)
    return goal


def test_targets():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.choice([0, 5, 40, 900, 20_000]) for _ in range(rng.randrange(1, 9))]
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        got = mixing.targets(np.array(sizes), np.array(weights, float))
        assert np.allclose(got, plain_targets(sizes, weights))


def sources_of(docs):
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(brute.WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = plain_targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])
    return {s: (sizes[s], g) for s, g in zip(order, goal, strict=True)}


def edge_docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(1, 60))), rng.choice(["b", "a", None, "ä"])) for i in range(400)]
    rows += [(7, "twice here", "a"), (7, "twice here", "a"), (None, "no id at all", "b"), (900, None, "a"), (901, " \t\n", "empty"), (902, "word " * 30_000, "c")]
    return spark.createDataFrame([(d, t, "en", s, 0, "own") for d, t, s in rows], DOCS)


@pytest.mark.parametrize("source", ["edge", "table", "small"])
def test_taken(spark, monkeypatch, source):
    if source == "small":
        monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    docs = table(spark, "/root/testdata/sf0.001", "documents") if source == "table" else edge_docs(spark)
    rows = mixing.taken_words(docs).collect()
    assert rows == mixing.taken_words(docs).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.taken_words(docs.repartition(5)).collect()))
    wanted = sources_of(docs)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(brute.WORD.findall(r.text or ""))) for r in docs.collect())
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    taken = defaultdict(int)
    for r in rows:
        taken[r.source_size, round(r.target, 6)] += r.taken
    for size, goal in wanted.values():
        assert abs(taken[size, round(goal, 6)] - goal) <= max(2, 0.02 * goal)


def test_documents_of_the_mix(spark):
    docs = edge_docs(spark)
    want = Counter()
    for r in mixing.taken_words(docs).collect():
        want[r.doc_id] += r.taken
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(brute.WORD.findall(r.text))
        assert r.n_chars == len(r.text) and r["size"] == "own"
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert mixing.taken_words(none).collect() == [] and mixing.mixed_documents(none).collect() == []
    blank = spark.createDataFrame([(1, None, "en", None, 0, "x"), (2, "", "en", "s", 0, "x")], DOCS)
    assert [(r.target, r.taken) for r in mixing.taken_words(blank).collect()] == [(0.0, 0)] * 2
