"""Byte-level BPE against the tiktoken library."""

from __future__ import annotations

import hashlib
import random
import sys
import time
import unicodedata

import public_tokenizers
import pytest
import regex
import tiktoken

from updraft.llm import byte_bpe
from updraft.llm.common import table
from updraft.llm.rank_queue import PairMerger

SF = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def words():
    return byte_bpe.vocabulary(byte_bpe.vocabulary_path())


@pytest.fixture(scope="module")
def library(words):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})


def ids(words, text):
    return [i for part in words.encode(text) for i in part.tolist()]


def expected(library, text):
    found = library.encode_ordinary(text or "")
    return len(found), hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_random_texts(words, library):
    rng = random.Random(11)
    signs = [*"aAbs'1! \n\t\r\x1c\x1f\x85\xa0", " ", "​", "½", "Ⅷ", "א", "中", "😀", "ß", "́", "﻿", "\U0003d000"]
    for _ in range(5000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(15)))
        assert ids(words, text) == library.encode_ordinary(text), text
        assert words.decode(ids(words, text)) == text.encode()


def test_every_character_is_cut_as_by_the_library(words, library):
    everything = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    late = [c for c in everything if unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{N}]", c)]
    assert late  # the regex module knows letters that the library does not
    for at in range(0, len(everything), 4099):
        text = "".join(f"a{c}1{c}!{c} {c}" for c in everything[at : at + 4099])
        assert ids(words, text) == library.encode_ordinary(text)


def test_long_matches(words, library):
    rng = random.Random(2)
    for text in ("a" * 100_001, "ab" * 30_000, " " * 50_000 + "x", "é" * 9_999, "".join(rng.choice("abcdef") for _ in range(60_000))):
        assert ids(words, text) == library.encode_ordinary(text)


def test_merging_takes_time_in_proportion(words):
    merger = PairMerger(words.ranks)
    piece = bytes(random.Random(4).choice(b"abcdefgh") for _ in range(160_000))
    seconds = []
    for n in (40_000, 160_000):
        start = time.perf_counter()
        merger.merge(piece[:n])
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 12 * seconds[0]


def test_turns_of_long_texts(words, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "TURN", 7)
    monkeypatch.setattr(byte_bpe, "LISTED_CHARS", 10)
    text = "Some words, 12 of them: it's ՘ and \U0003d000 more  and more.\n\n" * 9
    assert ids(words, text) == library.encode_ordinary(text)


def test_table_and_edges(spark, library):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rows = [(None, "lonely"), (10**6, None), (10**6 + 1, ""), (2**53 + 1, "x"), (7, "again"), (10**6 + 2, "<|endoftext|> a " * 40_000)]
    docs = docs.union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs.selectExpr("*", "1 AS n_tokens")).collect())
    assert got == sorted((str(r.doc_id), *expected(library, r.text)) for r in docs.collect())
    assert ("1000000", 0, EMPTY, EMPTY) in got


def test_ids_and_texts(spark, library):
    docs = spark.createDataFrame([(1, "Grüße  an\nalle"), (2, None), (None, "x")], "doc_id long, text string")
    found = byte_bpe.encoded(docs)
    assert {r.doc_id: r.ids for r in found.collect()} == {1: library.encode_ordinary("Grüße  an\nalle"), 2: [], None: library.encode_ordinary("x")}
    assert {r.doc_id: r.text for r in byte_bpe.decoded(found).collect()} == {1: "Grüße  an\nalle", 2: "", None: "x"}


def test_empty_table(spark):
    assert byte_bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []
