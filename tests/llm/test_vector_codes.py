"""Product codes: the tree against all distances, the table against SQL and a plain restatement."""

from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pytest

from updraft.llm import vector_codes
from updraft.llm.common import table
from updraft.llm.gnat import Gnat

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("spread, size, width", [(2, 64, 4), (40, 64, 4), (1000, 256, 8), (0, 20, 3), (5, 1, 4), (10**6, 64, 2)])
def test_tree_finds_the_first_nearest_entry(spread, size, width):
    rng = np.random.default_rng(spread + size)
    book = rng.integers(-spread, spread + 1, (size, width))
    queries = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (3000, width)), book, (book[:1] + book) // 2])
    squares = ((queries[:, None] - book) ** 2).sum(axis=2)
    tree = Gnat(book)
    index, best = tree.nearest(queries)
    assert (index == squares.argmin(axis=1)).all() and (best == squares.min(axis=1)).all()


def test_whole_subtrees_are_left_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (8, 4))
    book = (centres[:, None] + rng.integers(-40, 40, (8, 8, 4))).reshape(64, 4)
    tree = Gnat(book)
    tree.nearest(book[rng.integers(0, 64, 2000)] + rng.integers(-20, 20, (2000, 4)))
    assert tree.measured < 2000 * 64 / 2


def plain(rows, parts, entries, rounds):
    """The contract in loops over Python's whole numbers."""
    kept = sorted((i, [int(np.floor(np.float64(x) * 256)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        gaps = [[[sum((x - y) ** 2 for x, y in zip(c[p], e)) for e in books[p]] for p in range(parts)] for c in cut]
        return [[(min(g), g.index(min(g))) for g in row] for row in gaps]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{e:02x}" for _, e in f), s, by_label[lab], digest) for (i, _, lab), f, s in zip(kept, found, errors))


def test_small_tables_match_the_contract(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)], int(rng.integers(0, 3)) if i % 5 else None) for i in rng.permutation(60)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(200, None, 1), (201, [None] * 8, 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] + [0.0] * 7, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for parts, entries in ((4, 8), (2, 100)):
        got = vector_codes.vector_codes(docs.selectExpr("*", "'x' AS code", "2 AS error"), parts, entries, 2)
        assert sorted(tuple(r) for r in got.collect()) == plain(rows, parts, entries, 2)


def test_table_matches_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    got = vector_codes.vector_codes(table(spark, path, "embeddings"))
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(con.sql(vector_codes.SQL).project(", ".join(names)).fetchall())


def test_edges(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, [0.5] * 16, 1), (2, [0.5] * 17, 1), (None, [0.25] * 16, None), (3, [1e30] * 16, None), (1, [0.5] * 16, 1), (4, [], 2)]
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    zeros, last = "00" * 16, "02" * 16
    assert got == sorted([(1, zeros, 0, 0), (1, zeros, 0, 0), (2, None, None, 0), (None, last, 0, 0), (3, None, None, 0), (4, None, None, None)], key=str)
    with pytest.raises(ValueError):
        vector_codes.vector_codes(spark.createDataFrame([(1, [0.5] * 15, 1)], SCHEMA))
