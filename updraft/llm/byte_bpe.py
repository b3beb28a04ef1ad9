"""Byte-level BPE: ids of whole texts by merge ranks, and their bytes again.

A text is cut by the vocabulary's pattern. A match that is in the vocabulary is
one id; every other one starts as a linked list of its bytes. Each neighbouring
pair that is a token waits in a rank queue under that token's rank; the lowest
rank merges first, leftmost first. Merging pushes the two pairs that it forms;
what it made void stays in the queue and is skipped when met, since the list
knows the present rank of each pair. A match of n bytes takes about n steps,
however long it is.

A worker keeps the ids of matches, and of the stretches between single spaces, that it has met.

The pattern's letter and number classes are those of the Unicode version of the
``tiktoken`` library. The ``regex`` module may know later letters, so characters
on which the two differ are replaced for the cut, one for one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import islice

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updraft.llm.common import map_exact, ship
from updraft.llm.rank_queue import PairMerger

VOCABULARY = "byte_bpe_50k.tiktoken"
ID_TYPE = np.dtype("<u4")
#: Matches, and stretches, of a generation whose ids one worker keeps, and the longest of them in characters.
KEPT_WORDS, KEPT_CHARS = 500_000, 24
#: Matches that are looked up together; longer texts take several turns.
TURN = 200_000
#: Characters up to which a text's matches are listed at once, and after which a text is cut at the next safe space.
LISTED_CHARS = 1 << 20
#: A single space between two visible characters: no match reaches across it, the next one begins with it.
_SAFE = re.compile(r"(?<=\S) (?=\S)")

def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


@cache
def _stand_ins() -> dict[int, str]:
    """Characters that the two libraries class differently, each with one of the class that counts.

    Only characters that Python's own tables do not know yet can differ. Each is
    put behind a letter, a digit and a sign: the one that it merges with tells its class.
    """
    ranks = {bytes([b]): b for b in range(256)}
    for sign in b"a1!":
        ranks |= {bytes([sign, b]): len(ranks) + b - 0x80 for b in range(0x80, 256)}
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    pattern = regex.compile(public_tokenizers.PATTERN)
    found = {}
    for c in regex.findall(r"[\p{L}\p{N}\s]", everything):
        if unicodedata.category(c) != "Cn":
            continue
        joins = [probe.encode_ordinary(sign + c)[0] >= 256 for sign in "a1!"]
        if joins != [len(pattern.findall(sign + c)) == 1 for sign in "a1!"]:
            # Behind none of them: white space.
            found[ord(c)] = "a1! "[joins.index(True) if True in joins else 3]
    return found


@cache
def _differing() -> re.Pattern:
    """Finds texts that may hold such a character: any above U+FFFF counts, which keeps the class a table look-up."""
    low = "".join(chr(c) for c in _stand_ins() if c < 0x10000)
    return re.compile(f"[{low}\U00010000-\U0010ffff]")


@cache
def _pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def matches(text: str) -> Iterator[list[str]]:
    """The pattern's matches in order, in lists of bounded length."""
    if text.isascii() or not _differing().search(text):
        if len(text) <= LISTED_CHARS:
            yield _pattern().findall(text)
            return
        cut = (m.group() for m in _pattern().finditer(text))
    else:
        cut = (text[slice(*m.span())] for m in _pattern().finditer(text.translate(_stand_ins())))
    while part := list(islice(cut, TURN)):
        yield part


class Kept(dict):
    """Ids of words met of late; those of the generation before come back when asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}

    def again(self, word: str) -> bytes | None:
        ids = self.older.pop(word, None)
        if ids is not None:
            self[word] = ids
        return ids

    def turn(self) -> None:
        if len(self) > KEPT_WORDS:
            self.older = dict(self)
            self.clear()


class Vocabulary:
    """Token bytes by rank, and the work of encoding and decoding with them."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as source:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(rank) for rank in range(len(self.tokens))]
        #: Ids of matches, and of whole stretches by the text after their space.
        self._matches = Kept()
        self._stretches = Kept()

    @cached_property
    def _merger(self) -> PairMerger:
        return PairMerger(self.ranks)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match: its own one if the vocabulary has it whole."""
        whole = self.ranks.get(piece)
        return self._merger.merge(piece) if whole is None else [whole]

    def _match_ids(self, word: str) -> bytes:
        if ids := self._matches.again(word):
            return ids
        found = self.merge(word.encode())
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= KEPT_CHARS:
            self._matches[word] = ids
        return ids

    def _stretch_ids(self, stretch: str) -> bytes:
        """Ids of what stands between two safe spaces, with the first of them."""
        if ids := self._stretches.again(stretch[1:]):
            return ids
        known = self._matches
        ids = b"".join([known.get(w) or self._match_ids(w) for words in matches(stretch) for w in words])
        if len(stretch) <= KEPT_CHARS:
            self._stretches[stretch[1:]] = ids
        return ids

    def encode(self, text: str | None) -> Iterator[np.ndarray]:
        """The text's ids, in turns of bounded size wherever the text has safe spaces."""
        text = text or ""
        at = 0
        while at < len(text):
            self._matches.turn()
            self._stretches.turn()
            cut = _SAFE.search(text, at + LISTED_CHARS) if len(text) - at > LISTED_CHARS else None
            part = text[at : cut.start() if cut else len(text)]
            at += len(part)
            head, *rest = _SAFE.split(part)
            known = self._matches
            # The first stretch has its space, if any, with it.
            found = [known.get(w) or self._match_ids(w) for words in matches(head) for w in words]
            ids = list(map(self._stretches.get, rest))
            if None in ids:
                ids = [self._stretch_ids(" " + w) if i is None else i for w, i in zip(rest, ids, strict=True)]
            yield np.frombuffer(b"".join(found + ids), ID_TYPE)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _round_trip(path: str):
    def row(words: Vocabulary, text: str | None) -> tuple[int, str, str]:
        digits, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
        for part in words.encode(text):
            ids = part.tolist()
            if n and ids:
                digits.update(b" ")
            digits.update(" ".join(map(words.decimal.__getitem__, ids)).encode())
            decoded.update(words.decode(ids))
            n += len(ids)
        return n, digits.hexdigest(), decoded.hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path)
        for batch in batches:
            rows = [row(words, text) for text in batch["text"]]
            found = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield found.assign(doc_id=batch["doc_id"].to_numpy())[["doc_id", *found.columns]]

    return run


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of ``docs``.

    A null text counts as empty: no ids, and the digests of the empty text. Null
    and repeated ids come back as they are, one row for each row; an empty table
    gives an empty result; columns besides doc_id and text are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_exact(rows, _round_trip(path or vocabulary_path()), schema, "doc_id")


def _ids(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path)
        for batch in batches:
            ids = [np.concatenate([np.zeros(0, ID_TYPE), *words.encode(t)]).astype(np.int32) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})

    return run


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) for every row of ``docs``; edges as in :func:`round_trip`."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return map_exact(rows, _ids(path or vocabulary_path()), "doc_id long, ids array<int>", "doc_id")


def _texts(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path)
        for batch in batches:
            texts = [words.decode([] if i is None else i.tolist()).decode("utf-8", "replace") for i in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts})

    return run


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text for rows of doc_id and ids; null ids give the empty text, cut characters U+FFFD."""
    ship(ids.sparkSession)
    rows = ids.select(F.col("doc_id").cast("long"), "ids")
    return map_exact(rows, _texts(path or vocabulary_path()), "doc_id long, text string", "doc_id")
