"""Tokenizing, packing and token files."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from updraft.llm import packing, token_files, tokens
from updraft.llm.common import table
from updraft.llm.elias_fano import EliasFano

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, part string, ids string"
PATH = tokens.vocabulary_path()


def plain_ids(text):
    return tokens._tokenizer(PATH).encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def edge_docs(spark):
    rows = [
        (5, None, "p", "i"), (3, "", "p", "i"), (3, "same id", None, None), (None, "no id", "p", "i"), (9, "x  y\n z ", "p", "i"),
        (9, "x  y\n z ", "p", "i"), (-4, "long text, ümlaut \U0001f600 <|endoftext|> " * 900, "p", "i"),
    ]
    return spark.createDataFrame(rows, DOCS)


@given(st.lists(st.sampled_from(
    ["a", " the", "thing.", "Wö", " ing$$$", " ", "  ", "\n", "'s", "23", "!", " ", "　", "\u0085", "​", "\x1c", "中", "-"]
), max_size=16))
@settings(max_examples=300, deadline=None)
def test_words_give_the_ids_of_the_text(parts):
    text = "".join(parts)
    got = np.frombuffer(tokens.encode_all(PATH, [text])[0], "<u4").tolist()
    assert got == plain_ids(text)[:-1]


def library_ids(text):
    """By the library alone, with nothing of the engine's set on it."""
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


SPECIAL_TEXTS = [
    "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|> b", "a<|endoftext|>b", "a  <|endoftext|>  b", "a\n<|endoftext|>\n b", "x <|endoftext|><|endoftext|> y.",
    "<|endoftext|", "< |endoftext|>", "<|ENDOFTEXT|>", "a\0 <|endoftext|> b", " <|endoftext|> " * 3,
]


@pytest.mark.parametrize("text", SPECIAL_TEXTS)
def test_special_names_are_the_librarys(text):
    for _ in range(2):  # the second time from kept words
        assert np.frombuffer(tokens.encode_all(PATH, [text])[0], "<u4").tolist() == library_ids(text)


def test_special_names_in_files_and_windows(spark, tmp_path):
    assert library_ids("a <|endoftext|> b") == [64, 220, 50256, 275]
    want = {k: library_ids(text) + [tokens.END_ID] for k, text in enumerate(SPECIAL_TEXTS)}
    docs = spark.createDataFrame(list(enumerate(SPECIAL_TEXTS)), "doc_id long, text string")
    got = sorted(token_files.round_trip(docs, str(tmp_path / "out")).collect(), key=lambda r: r.doc_id)
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(i), crc(i)) for i in want.values()]
    assert [r.start for r in got] == np.cumsum([0, *map(len, want.values())])[:-1].tolist()
    for r in packing.pack(docs).collect():
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length])


@given(st.lists(st.integers(0, 10**6), max_size=1500))
@settings(max_examples=60, deadline=None)
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, np.int64))
    coded = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
    assert coded.all().tolist() == values.tolist()
    assert [v for run in coded.runs() for v in run.tolist()] == values.tolist()
    with pytest.raises(IndexError):
        coded.run(len(coded.samples))
    for i in random.Random(1).sample(range(len(values)), min(40, len(values))):
        assert coded.select(i) == values[i]


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(3).integers(1, 2000, 100_000))
    assert len(EliasFano.encode(values).to_bytes()) * 8 / len(values) < 2 + np.log2(1000) + 1
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([3, 2]))


def expected_files(docs):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    return [(r.doc_id, len(ids), crc(ids)) for r in rows for ids in [plain_ids(r.text)]]


@pytest.mark.parametrize("source", ["edge", "table"])
def test_token_files(spark, tmp_path, monkeypatch, source):
    monkeypatch.setattr(token_files, "FILE_IDS", 5_000)
    docs = edge_docs(spark) if source == "edge" else table(spark, SF, "documents")
    got = sorted(token_files.round_trip(docs, str(tmp_path / "out")).collect(), key=lambda r: r.start)
    want = expected_files(docs)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (d is not None, d or 0, n, c) for d, n, c in want
    )
    assert [r.doc_id for r in got] == [d for d, _, _ in want]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    files = list((tmp_path / "out").iterdir())
    data = files[0].read_bytes()
    ids, ends, _ = token_files.unpack_file(data)
    assert np.concatenate([token_files.document_ids(data, i) for i in range(len(ends))]).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        token_files.unpack_file(data[:-1])


@pytest.mark.parametrize("source", ["edge", "table"])
def test_packing(spark, source):
    docs = edge_docs(spark) if source == "edge" else table(spark, SF, "documents")
    rows = packing.pack(docs, open_windows=8).collect()
    assert rows and list(rows[0].asDict()) == "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append(r)
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    texts = defaultdict(list)
    for r in docs.collect():
        ids = plain_ids(r.text)
        texts[r.doc_id, len(ids)].append(ids)
    assert set(texts) == set(pieces)
    total = sum(len(i) for group in texts.values() for i in group)
    assert sum(r.length for r in rows) == total and padding <= 0.01 * total
    for key, group in texts.items():
        found = sorted((r.start, r.length, r.ids_crc32) for r in pieces[key])
        if len(group) == 1:
            at = 0
            for start, length, code in found:
                assert start == at and code == crc(group[0][start : start + length])
                at += length
            assert at == len(group[0])


def test_readers_are_as_many_as_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 3_000)
    monkeypatch.setattr(token_files, "FILES_READ", 1)
    folder = str(tmp_path / "out")
    manifest = token_files.write_files(table(spark, SF, "documents"), folder)
    files = manifest.count()
    found = token_files.read_files(manifest, folder).withColumn("task", F.spark_partition_id())
    assert files > 20 and found.select("task").distinct().count() > files // 2
    monkeypatch.undo()
    again = token_files.read_files(manifest, folder)
    assert again.exceptAll(found.drop("task")).isEmpty() and again.count() == found.count()


def test_boundaries_come_from_select(spark, tmp_path, monkeypatch):
    docs = spark.range(1300).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    manifest = token_files.write_files(docs.coalesce(1), str(tmp_path))
    data = (tmp_path / manifest.first().file).read_bytes()
    monkeypatch.setattr(EliasFano, "all", None)
    (batch, *more) = token_files._reader(str(tmp_path))([manifest.limit(1).selectExpr("file", "0 AS before").toPandas()])
    assert len(batch) <= 512 and sum(map(len, [batch, *more])) == token_files.unpack_file(data)[1].n
    monkeypatch.setattr(EliasFano, "run", None)
    with pytest.raises(TypeError):
        list(token_files._reader(str(tmp_path))([manifest.selectExpr("file", "0 AS before").toPandas()]))


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    assert packing.pack(none).collect() == []
    assert token_files.round_trip(none, str(tmp_path / "none")).collect() == []


def test_a_packing_task_leaves_no_words_behind():
    path = tokens.vocabulary_path()
    batch = pd.DataFrame({"doc_id": ["1", "2"], "text": ["some words of a text", "and other words"], "part": [0, 0]})
    rows = pd.concat(packing._first_pass(path, 1024, 4)(iter([batch])))
    assert rows["length"].sum() > 6 and not tokens._known(path).recent and not tokens._known(path).before


def kept_apart(monkeypatch, recent):
    """Only the given kept words, and a list of those that take the whole way."""
    monkeypatch.setattr(tokens, "_known", lambda path, known=tokens.Known(recent): known)
    whole = []
    monkeypatch.setattr(tokens, "_encode", lambda path, parts, real=tokens._encode: whole.extend(parts) or real(path, parts))
    return whole


def test_each_word_is_looked_up_once(monkeypatch):
    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    kept_apart(monkeypatch, Counted())
    texts = ["the same four words " * 500 + f"and number{i}" for i in range(20)]
    for _ in range(2):  # the second time from kept words
        got = [np.frombuffer(i, "<u4").tolist() for i in tokens.encode_all(PATH, texts)]
        assert got == [library_ids(t) for t in texts]
    assert Counted.asked < 200


def test_lines_of_plain_words_go_to_the_model(monkeypatch):
    whole = kept_apart(monkeypatch, {})
    texts = ["One line.\nThe next, and\nÊtre&&& or\nüber an end.\nLast", "a\nb", "Été.\nà"]
    assert [np.frombuffer(i, "<u4").tolist() for i in tokens.encode_all(PATH, texts)] == [library_ids(t) for t in texts]
    assert not whole
    texts = ["a\nb\nc", "a\n\nb", "a.\n b", "a\n", "\na", "a\u0085b", "a \nb", "a\n'b", "'\nb", "", None]
    assert [np.frombuffer(i, "<u4").tolist() for i in tokens.encode_all(PATH, texts)] == [library_ids(t or "") for t in texts]


def test_texts_apart_keep_their_places(monkeypatch):
    kept_apart(monkeypatch, {})
    texts = ["plain words", "two  blanks", "", "more words", "a\0 b", None, " edge", "words again", "end\n "]
    assert [np.frombuffer(i, "<u4").tolist() for i in tokens.encode_all(PATH, texts)] == [library_ids(t or "") for t in texts]


def test_a_space_at_the_start_goes_with_its_word(monkeypatch):
    whole = kept_apart(monkeypatch, {})
    texts = [" Some words", " a", " über all.\nWords", "Some words"]
    assert [np.frombuffer(i, "<u4").tolist() for i in tokens.encode_all(PATH, texts)] == [library_ids(t) for t in texts]
    assert not whole
    texts = [" ", "  ", "  a", " \nb", " a ", " \0a", " <|endoftext|> b"]
    assert [np.frombuffer(i, "<u4").tolist() for i in tokens.encode_all(PATH, texts)] == [library_ids(t) for t in texts]
