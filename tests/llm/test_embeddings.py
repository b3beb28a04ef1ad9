"""Near-duplicate vectors against brute force."""

from __future__ import annotations

from collections import Counter

import brute
import numpy as np

from updraft.llm import embedding_dedup as ed
from updraft.llm.common import table

VECTORS = "vec_id long, embedding array<float>, label int, kept string, n_links string"


def expected(rows, cosine=ed.COSINE):
    usable = {}
    for vec_id, vector, label in rows:
        if vector is None or label is None or any(v is None for v in vector):
            continue
        values = np.array(vector, np.float32).astype(float)
        if len(values) and np.isfinite(values).all() and values.any():
            usable[vec_id] = (label, values / np.linalg.norm(values))
    edges = []
    for label in {x for x, _ in usable.values()}:
        ids = sorted(i for i, (x, _) in usable.items() if x == label)
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if len(usable[a][1]) == len(usable[b][1]) and usable[a][1] @ usable[b][1] >= cosine:
                    edges.append((a, b))
    links = Counter(x for e in edges for x in e)
    parts = brute.components([r[0] for r in rows], edges)
    return {r[0]: (links[r[0]], parts[r[0]], parts[r[0]] == r[0]) for r in rows}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def made(rng, n, dim, labels):
    rows, base = [], None
    for i in range(n):
        if base is None or rng.random() < 0.4:
            base = rng.standard_normal(dim)
        noise = rng.choice([0.0, 0.1, 0.3, 0.45]) * rng.standard_normal(dim)
        rows.append((i, [float(np.float32(v)) for v in base + noise], int(rng.integers(labels))))
    return rows


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ed, "BUCKET", 64)
    rows = made(np.random.default_rng(8), 700, 24, 3)
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    want = expected(rows)
    assert got(ed.embedding_links(frame)) == want
    assert max(n for n, _, _ in want.values()) > 3


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 16)
    rng = np.random.default_rng(9)
    base = rng.standard_normal(16)
    rows = [(i, [float(np.float32(v)) for v in base + 0.15 * rng.standard_normal(16)], 1) for i in range(120)]
    assert got(ed.embedding_links(spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS))) == expected(rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (6, [], 1), (7, [1.0, 0.0], None),
        (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [2.0, 0.0], 1), (11, [1.0, 0.0], 2), (12, [-0.0, 3.0], 1), (13, [0.0, 3.0], 1),
        (14, [1.0, 0.0, 0.0], 1), (15, [5.0], 3), (16, [4.0], 3),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    found = got(ed.embedding_links(frame))
    assert found == expected(rows)
    assert found[10] == (2, 8, False) and found[13] == (1, 12, False)
    assert ed.embedding_links(frame.limit(0)).collect() == []
    twice = ed.embedding_links(frame.where("vec_id = 8").unionByName(frame.where("vec_id = 8"))).collect()
    assert [(r.n_links, r.component_id, r.kept) for r in twice] == [(1, 8, True)] * 2
    lost = spark.createDataFrame([(None, [1.0, 0.0], 1, "x", "y")], VECTORS)
    assert [tuple(r) for r in ed.embedding_links(lost).collect()] == [(None, 0, None, True)]


def test_table(spark):
    frame = table(spark, "/root/testdata/sf0.001", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    assert got(ed.embedding_links(frame)) == expected(rows)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    for dim in (64, 100):
        unit = rng.standard_normal((400, dim))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        code = ed.codes(unit)
        about, width = ed.estimates(dim, code, code)
        error = (about - unit @ unit.T)[~np.eye(400, dtype=bool)]
        assert abs(error.mean()) < 2e-3
        assert (np.abs(about - unit @ unit.T) <= width).mean() > 0.9999


def test_estimates_are_the_product_of_steps_and_signs():
    rng = np.random.default_rng(5)
    unit = rng.standard_normal((30, 70))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    code = ed.codes(unit)
    bits = np.unpackbits(code.planes.view(np.uint8), axis=2)[:, :, :70]
    steps = (bits * (1 << np.arange(ed.PLANES))[None, :, None]).sum(axis=1)
    turned = unit @ ed.rotation(70, 0).T
    assert (np.abs(code.low[:, None] + code.step[:, None] * steps - turned) <= code.step[:, None] * (1 + 1e-9)).all()
    plain = (code.low[:, None] + code.step[:, None] * steps) @ np.where(turned >= 0, 1, -1).T / np.sqrt(70) / code.factor
    assert np.allclose(plain, ed.estimates(70, code, code)[0])


def test_codes_decide_which_pairs_are_computed(spark):
    rows = made(np.random.default_rng(6), 400, 256, 1)
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    want = expected(rows)
    distinct = sorted({tuple(v) for _, v, _ in rows})
    classes = [(0, np.array(v, "<f4").tobytes(), i) for i, v in enumerate(distinct)]
    opened = ed.open_pairs(spark.createDataFrame(classes, "label long, vector binary, class long"), *ed.band_plan(len(classes), ed.COSINE), ed.COSINE)
    computed = sum(int(np.unpackbits(np.frombuffer(r.open, np.uint8)).sum()) for r in opened.where("NOT upper").collect())
    assert 0 < computed < len(classes) * (len(classes) - 1) / 2 / 10
    assert got(ed.embedding_links(frame)) == want
    # Intervals that reach nothing leave only the links of equal vectors.
    copies = Counter(tuple(v) for _, v, _ in rows)
    none = got(ed.embedding_links(frame, width=-1000.0))
    assert {i: n for i, (n, _, _) in none.items()} == {i: copies[tuple(v)] - 1 for i, v, _ in rows}


def test_an_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)
    found = ed.embedding_links(frame).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
