"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline as cp
from updraft.llm import quality, tokens
from updraft.llm.common import cut_lineage, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [table(spark, SF, "documents")]
    for name, stage in cp.STAGES:
        docs.append(cut_lineage(stage(spark, docs[-1], SF), name.replace(" ", "-")))
    return docs


def rows(df):
    return df.collect()


def test_columns(steps):
    names = "doc_id text lang source n_chars".split()
    assert [d.columns for d in steps[:-1]] == [names] * 5
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "mixing to target weights", "packing"]


def test_quality_stage(spark, steps):
    model = quality.fit(steps[0], table(spark, SF, "labels"))
    docs = rows(steps[0])
    good = [r for r, s in zip(docs, model.score([r.text for r in docs]), strict=True) if s >= 0.5]
    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in rows(steps[1])) and len(good) < len(docs)


def test_exact_stage(steps):
    first = {}
    for r in sorted(rows(steps[1]), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    assert sorted(map(str, first.values())) == sorted(map(str, rows(steps[2])))


def test_near_stage(steps):
    docs = rows(steps[2])
    found = brute.near_components([(r.doc_id, r.text) for r in docs], 5)
    assert sorted(map(str, (r for r in docs if found[r.doc_id][1] == r.doc_id))) == sorted(map(str, rows(steps[3])))


def test_mixing_stage(steps):
    before = {r.doc_id: r for r in rows(steps[3])}
    taken, sizes = Counter(), Counter()
    for r in before.values():
        sizes[r.source] += len(brute.WORD.findall(r.text or ""))
    for r in rows(steps[4]):
        assert r.text in before[r.doc_id].text and r.source == before[r.doc_id].source and r.n_chars == len(r.text)
        taken[r.source] += len(brute.WORD.findall(r.text))
    assert all(taken[s] <= 2 * n for s, n in sizes.items())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 0.01 * sum(sizes.values())


def test_packing_stage(steps):
    want = Counter()
    path = tokens.vocabulary_path()
    for r in rows(steps[4]):
        want[r.doc_id] += len(np.frombuffer(tokens.encode_all(path, [r.text])[0], tokens.ID_TYPE)) + 1
    got, ends = Counter(), defaultdict(list)
    for r in rows(steps[5]):
        got[r.doc_id] += r.length
        ends[r.sequence_id].append((r.offset, r.offset + r.length))
    assert got == want
    for parts in ends.values():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] <= 1024
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_run_and_registration(spark, steps):
    names = entry_points.queries()
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= set(names) | {re.match(r"op\d+_", n)[0] for n in names if n.startswith("op")}
    assert sorted(map(str, cp.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(str, steps[5].drop("sequence_id", "offset").collect()))


CLASHES = """_size _keep _key _id kept keep_id group_size score predicted held_out positive block shards _turn _shard taken copies size
    quota node head component_id n_shingles length start offset sequence_id own_5 own_7 kept_id""".split()


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_with_clashing_names_and_without_rows(spark, name, stage):
    docs = table(spark, SF, "documents").limit(120)
    extra = docs.selectExpr("*", *[f"concat('own', doc_id) AS `{c}`" for c in CLASHES])
    odd = spark.createDataFrame([(None, None, None, None, None, *["x"] * len(CLASHES))], extra.schema)
    found = stage(spark, extra.unionByName(odd), SF)
    if name != "packing":
        assert found.columns == extra.columns
        got = found.where("doc_id IS NOT NULL").collect()
        assert got and all(r[c] == f"own{r.doc_id}" for r in got for c in CLASHES)
        assert stage(spark, extra.limit(0), SF).columns == extra.columns
    assert stage(spark, extra.limit(0), SF).collect() == []
