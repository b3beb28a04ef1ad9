"""Token ids of whole texts by the ``tokenizers`` library, one call per new word.

The vocabulary's pre-tokenizer never joins what stands on the two sides of a
single space, so the ids of a text are the ids of its words, each with the space
before it. Arrow finds the distinct words of many texts at once, and puts the ids
of their words together again. A worker keeps the ids of the words that it has
met; only new words reach the tokenizer. Texts in which white space meets white
space, where the rule says nothing, are cut at the safe places only.

A plain word (Latin letters, then perhaps punctuation) is one pre-token, or two;
these go straight to the tokenizer's model. So do two plain words with a line
feed between them, which is a pre-token of its own there. Everything else takes
the whole way.
"""

from __future__ import annotations

import codecs
import os
import re
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already fill the cores

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from updraft.llm.common import in_pieces  # noqa: E402

VOCABULARY = "byte_bpe_50k.json"
#: Id that closes each document.
END_ID = 0
ID_TYPE = np.dtype("<u4")
#: Words of a generation whose ids one worker keeps, and the longest of them: longer ones seldom come back.
KEPT_WORDS, KEPT_CHARS = 500_000, 12
#: Characters that are handed to the tokenizer at once, and that are looked up together.
CALL_CHARS, PIECE_CHARS = 1 << 18, 1 << 21

#: Stands before a word that begins its text and so has no space in front.
_FIRST = "\0"
#: White space of any kind, also what only may count as such.
_BLANK = "\\s\u0085\u180e\u200b\u2060\ufeff"
#: Words next to which a space is not single: empty, or with a blank at an edge.
_UNSAFE = re.compile(f"{_FIRST}?(?:[{_BLANK}].*|.*[{_BLANK}])?", re.DOTALL)
_BODY, _MARK = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+", "[.,;:!?$%&#*|]*"
#: Latin letters, then perhaps punctuation; perhaps the same again on the next line.
_PLAIN = re.compile(f"({_FIRST}?{_BODY})({_MARK})(?:\n({_BODY})({_MARK}))?")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()
_ALPHABET = "".join(_LETTERS.get(b, chr(b)) for b in range(256))
_ID_BYTES = [i.to_bytes(ID_TYPE.itemsize, "little") for i in range(1 << 16)]


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


@cache
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@dataclass
class Known:
    """Words met of late, and those of the generation before."""

    recent: dict[str, bytes] = field(default_factory=dict)
    before: dict[str, bytes] = field(default_factory=dict)


@cache
def _known(path: str) -> Known:
    return Known()


def forget(path: str) -> None:
    """Drops the kept words; what follows learns them again."""
    known = _known(path)
    known.recent, known.before = {}, {}


@cache
def _tokenize(path: str):
    """The model's call for one pre-token; asking for the model costs as much as the call."""
    return _tokenizer(path).model.tokenize


def _pre_token(tokenize, word: str) -> bytes:
    """Ids of one pre-token, given with its space."""
    letters, _ = codecs.charmap_decode(word.encode(), "strict", _ALPHABET)
    return b"".join([_ID_BYTES[t.id] for t in tokenize(letters)])


def _as_text(word: str) -> str:
    return word[1:] if word[:1] == _FIRST else " " + word


def _plain_ids(path: str, words: list[str], known: Known) -> list[bytes | None]:
    """Ids of distinct words; None for a new word that is not plain."""
    recent, before, tokenize = known.recent, known.before, _tokenize(path)
    plainly, id_bytes, space = _PLAIN.fullmatch, _ID_BYTES, _LETTERS[32]
    found = list(map(recent.get, words))
    marks: dict[str, bytes] = {}
    bodies: dict[str, bytes] = {}

    def of_mark(mark: str) -> bytes:
        if mark not in marks:
            marks[mark] = _pre_token(tokenize, mark) if mark else b""
        return marks[mark]

    def of_body(body: str) -> bytes:
        ids = bodies.get(body) or recent.get(body) or before.get(body)
        if not ids:
            ids = bodies[body] = _pre_token(tokenize, _as_text(body))
        return ids

    for k in [k for k, ids in enumerate(found) if ids is None]:
        word = words[k]
        if before and (ids := before.get(word)):
            found[k] = recent[word] = ids
            continue
        if word.isascii() and word.isalpha():  # most words, so without a call
            ids = b"".join([id_bytes[t.id] for t in tokenize(space + word)])
        elif plain := plainly(word):
            body, mark, second, second_mark = plain.groups()
            ids = of_body(body) + of_mark(mark) if mark or second else _pre_token(tokenize, _as_text(body))
            if second:
                ids += of_mark("\n") + of_body(_FIRST + second) + of_mark(second_mark)
        else:
            continue
        found[k] = ids
        if len(word) <= KEPT_CHARS:
            recent[word] = ids
    return found


def _other_ids(path: str, words: list[str], known: Known) -> list[bytes]:
    """Ids of new words that are not plain."""
    found = _encode(path, [_as_text(w) for w in words])
    for word, ids in zip(words, found, strict=True):
        if len(word) <= KEPT_CHARS and not _UNSAFE.fullmatch(word):
            known.recent[word] = ids
    return found


def _encode(path: str, parts: list[str]) -> list[bytes]:
    """Ids of texts by the whole tokenizer."""
    found: list[bytes] = []
    at = 0
    while at < len(parts):
        end, held = at, 0
        while end < len(parts) and (end == at or held + len(parts[end]) <= CALL_CHARS):
            held += len(parts[end])
            end += 1
        # One call for many words: word_ids tell whose each id is.
        whole = _tokenizer(path).encode(parts[at:end], is_pretokenized=True, add_special_tokens=False)
        owner = np.array(whole.word_ids, np.int64)
        data = np.array(whole.ids, ID_TYPE).tobytes()
        ends = np.searchsorted(owner, np.arange(end - at + 1)) * ID_TYPE.itemsize
        found += [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        at = end
    return found


def _merged(words: list[str]) -> list[str]:
    """Joins the words again wherever the space between them is not single."""
    blank = re.compile(f"[{_BLANK}]")
    parts = words[:1]
    for word in words[1:]:
        last = parts[-1]
        if last in ("", _FIRST) or not word or blank.match(last[-1]) or blank.match(word[0]):
            parts[-1] = f"{last} {word}"
        else:
            parts.append(word)
    return parts


def encode_all(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, without the end id."""
    texts = [t or "" for t in texts]
    return [ids for part in in_pieces(texts, PIECE_CHARS) for ids in _encode_piece(path, texts[part])]


def _encode_piece(path: str, texts: list[str]) -> list[bytes]:
    known = _known(path)
    if len(known.recent) > KEPT_WORDS:
        known.before, known.recent = known.recent, {}
    apart = {i for i, text in enumerate(texts) if not text or _FIRST in text}
    # A space at the start goes with the first word like any other.
    whole = [None if i in apart else t[1:] if t[0] == " " else _FIRST + t for i, t in enumerate(texts)]
    cut = pc.split_pattern(pa.array(whole, pa.large_string()), " ")
    coded = cut.values.dictionary_encode()
    # By way of numpy, since Arrow's own lists are built element by element.
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    places, bounds = coded.indices, cut.offsets.to_numpy()
    ids = _plain_ids(path, words, known)
    other = [k for k, i in enumerate(ids) if i is None]
    # Plain and kept words have clean edges, so only the others can break the rule.
    unsafe = {k for k in other if _UNSAFE.fullmatch(words[k])}
    if unsafe:
        at = np.flatnonzero(np.isin(places.to_numpy(), list(unsafe)))
        apart.update((np.searchsorted(bounds, at, "right") - 1).tolist())
        other = [k for k in other if k not in unsafe]
    for k, i in zip(other, _other_ids(path, [words[k] for k in other], known), strict=True):
        ids[k] = i
    joined = pa.array(ids, pa.large_binary()).take(places)
    _, ends, data = joined.buffers()
    ends = np.frombuffer(ends, np.int64, len(joined) + 1)[bounds].tolist() if len(joined) else [0] * (len(texts) + 1)
    data = memoryview(data or b"")
    found = [bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    where = sorted(apart)
    for i, own in zip(where, _encode_apart(path, [texts[i] for i in where], known), strict=True):
        found[i] = own
    return found


def _encode_apart(path: str, texts: list[str], known: Known) -> list[bytes]:
    """Ids of texts that are empty, hold the first word's sign or white space next to white space."""
    parts = [[] if not t else [_FIRST + t] if _FIRST in t else _merged((_FIRST + t).split(" ")) for t in texts]
    words = list({w for own in parts for w in own})
    ids = _plain_ids(path, words, known)
    other = [k for k, i in enumerate(ids) if i is None]
    for k, i in zip(other, _other_ids(path, [words[k] for k in other], known), strict=True):
        ids[k] = i
    look = dict(zip(words, ids, strict=True)).__getitem__
    return [b"".join(map(look, own)) for own in parts]
