"""Secret scan: keyword automaton, anchored patterns near its hits, checksums.

One Aho-Corasick pass over a text finds every keyword. Patterns are only tried
where a keyword was hit, anchored there. Kinds whose format embeds a checksum
count only when it holds. Runs of hexadecimal digits have no keyword; their own
anchors are found with one run pattern.

The three base kinds (assign, access, hex) follow the leftmost non-overlapping
matches of their patterns. The checked kinds add to them and never replace them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updraft.llm.common import long_columns, map_exact

# Patterns of the base kinds.
ASSIGN = re.compile(rb"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_KEYWORD = "akia"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
BASE_KINDS = ("assign", "access", "hex")

# Public formats with an embedded check.
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
REPO_TOKEN = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z_])")
PACKAGE_TOKEN = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z_])")
WEB_TOKEN = re.compile(rb"(eyJ[0-9A-Za-z_-]+)\.(eyJ[0-9A-Za-z_-]+)\.[0-9A-Za-z_-]+")
ACCOUNT = re.compile(rb"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Z0-9])")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])")


def crc_base62(body: bytes) -> bytes:
    """CRC-32 of the body as six base-62 digits."""
    value, digits = zlib.crc32(body), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit : digit + 1] + digits
    return digits


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: bytes) -> bool:
    """The check of international account numbers."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(chr(c), 36)) for c in turned)) % 97 == 1


def _crc_ok(match: re.Match) -> bool:
    return crc_base62(match[1]) == match[2]


#: kind, keywords, pattern, check. A word character before a hit rules the kind out.
CHECKED: tuple[tuple[str, tuple[str, ...], re.Pattern, Callable[[re.Match], bool]], ...] = (
    ("repo_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), REPO_TOKEN, _crc_ok),
    ("package_token", ("npm_",), PACKAGE_TOKEN, _crc_ok),
    ("web_token", ("eyj",), WEB_TOKEN, lambda m: _json_object(m[1]) and _json_object(m[2])),
)
#: Kinds without a keyword of their own: a word that names them must stand within NEAR bytes before.
NEAR = 40
NAMED = (
    ("account", ("iban",), ACCOUNT, lambda m: mod97(m[0].replace(b" ", b""))),
    ("card", ("card", "visa", "mastercard"), CARD, lambda m: luhn(re.sub(rb"[ -]", b"", m[0]))),
)


def _json_object(part: bytes) -> bool:
    import base64
    import json

    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))), dict)
    except (ValueError, RecursionError):  # nested too deep to be a token
        return False


@cache
def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word in (*ASSIGN_KEYWORDS, ACCESS_KEYWORD):
        made.add_word(word, (word, None))
    for at, (_, words, _, _) in enumerate((*CHECKED, *NAMED)):
        for word in words:
            made.add_word(word, (word, at))
    made.make_automaton()
    return made


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes of the text's UTF-8 form, base kinds first, each kind in order."""
    return _scan(text.encode("utf-8", "surrogatepass"))


def _scan(data: bytes) -> list[tuple[str, int, int]]:
    # One character per byte, ASCII letters lower: hits are then byte positions.
    hits = [(end - len(word) + 1, word, at) for end, (word, at) in _automaton().iter(data.lower().decode("latin-1"))]
    hits.sort(key=lambda h: h[0])
    assign, access, more = [], [], []
    assign_free = access_free = 0
    free = dict.fromkeys(range(len(CHECKED) + len(NAMED)), 0)
    for start, word, at in hits:
        if at is not None:
            kind, _, pattern, holds = (*CHECKED, *NAMED)[at]
            if at < len(CHECKED):
                before = data[start - 1 : start]
                # A web token's own letters include these two: inside a run of them none begins, so each run is read once.
                inside = before.isalnum() or kind == "web_token" and before in (b"-", b"_")
                match = None if inside or start < free[at] else pattern.match(data, start)
                match = match if match and holds(match) else None
            else:
                match = _first_near(pattern, holds, data, max(free[at], start + len(word)))
            if match:
                more.append((kind, *match.span()))
                free[at] = match.end()
        elif word == ACCESS_KEYWORD:
            match = ACCESS.match(data, start) if start >= access_free else None
            if match:
                access_free = match.end()
                if match.end() - start >= ACCESS_LEAST:
                    access.append(("access", *match.span()))
        elif start >= assign_free and (match := ASSIGN.match(data, start)):
            assign_free = match.end()
            if len(match[1]) >= ASSIGN_LEAST:
                assign.append(("assign", *match.span()))
    return assign + access + [("hex", *m.span()) for m in HEX.finditer(data)] + more


def _first_near(pattern: re.Pattern, holds: Callable[[re.Match], bool], data: bytes, after: int) -> re.Match | None:
    """The first match near a keyword whose check holds, the longest at its place."""
    for at in range(after, min(len(data), after + NEAR)):
        if not data[at - 1 : at].isalnum() and (match := pattern.match(data, at)):
            # A number may end before any of its separators; what follows is then no part of it.
            for end in (match.end(), *(e for e in range(match.end() - 1, at, -1) if not data[e : e + 1].isalnum())):
                if (shorter := pattern.fullmatch(data, at, end)) and holds(shorter):
                    return shorter
    return None


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


KINDS = (*BASE_KINDS, *(c[0] for c in CHECKED), *(c[0] for c in NAMED))
_ORDER = {kind: i for i, kind in enumerate(KINDS)}


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = _scan(data)
    if found and not data.isascii():
        follow = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)])
        found = [(k, a - int(follow[a]), b - int(follow[b])) for k, a, b in found]
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            spans = spans_of(text)
            base = [s for s in spans if s[0] in BASE_KINDS]
            counts = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
            rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        out.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield out


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of ``docs`` (doc_id, text).

    Null and empty texts have no span. Null ids and repeated rows pass like any
    other row; other columns are ignored; an empty table gives an empty result.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_exact(docs.select(F.col("doc_id").cast("long"), "text"), _rows, schema, "doc_id")


def masked(docs: DataFrame, mask: str = "[{kind}]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced; overlapping spans merge under the first kind."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [None if t is None else _masked(t, spans_of(t), mask) for t in batch["text"]]
            yield batch

    return map_exact(docs, run, docs.schema, *long_columns(docs))


def _masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], mask.format(kind=kind)]
        at = max(at, end)
    return "".join([*parts, text[at:]])
