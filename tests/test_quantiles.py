from __future__ import annotations

import numpy as np
import pytest

from updraft.operators import quantiles
from updraft.operators.quantiles import group_quantiles


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_equal_numpy_for_hot_small_and_null_groups(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(6)
    data = {"hot": np.round(rng.normal(1, 2, 4000), 2), None: rng.uniform(0, 1, 37), "one": np.array([4.25]), "tied": np.repeat([1.0, 2.0], [300, 301])}
    rows = [(k, float(v)) for k, values in data.items() for v in values] + [("hot", None), ("void", None)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE").repartition(5)
    shares = {"q25": ("v", 0.25), "q50": ("v", 0.5), "q90": ("v", 0.9), "q100": ("v", 1.0)}
    got = {r.k: (r.q25, r.q50, r.q90, r.q100) for r in group_quantiles(df, ["k"], shares).collect()}
    want = {k: pytest.approx(tuple(np.quantile(v, [0.25, 0.5, 0.9, 1.0]))) for k, v in data.items()}
    assert got == want


def test_quantiles_without_keys(spark):
    df = spark.range(1, 102).selectExpr("CAST(id AS DOUBLE) AS v")
    assert group_quantiles(df, [], {"m": ("v", 0.5)}).first().m == 51.0
