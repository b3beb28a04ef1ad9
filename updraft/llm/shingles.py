"""Sets of word shingles as 64-bit values, computed over whole Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np

from updraft.llm.common import in_pieces, mix64

BASE = 0x9E3779B97F4A7C15
PIECE_CHARS = 1 << 20
#: Bytes from which on a word is hashed by a digest.
LONG_WORD = 64
_SPREAD = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
#: Letters A-Z take the value of a-z.
_SPREAD[ord("A") : ord("Z") + 1] = _SPREAD[ord("a") : ord("z") + 1]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words start (one entry more than texts)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    up, down = _powers(len(data))
    inside = ~_IS_SPACE[data]
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_SPREAD[data] * up, out=sums[1:])
    words = mix64((sums[ends] - sums[starts]) * down[starts])
    # Long words of few letters can be built so that the sum is equal; a digest tells them apart.
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        word = data[starts[i] : ends[i]].tobytes().lower()
        words[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return words, np.searchsorted(starts, begins)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text its distinct shingles of ``width`` words, sorted.

    A text with fewer words has one shingle, the whole sequence; a text without
    words, or null, has none.
    """
    texts = [t or "" for t in texts]
    weights = np.array([(BASE * (2 * k + 3)) % (1 << 64) | 1 for k in range(width)], np.uint64)
    sets: list[np.ndarray] = []
    for piece in in_pieces(texts, PIECE_CHARS):
        words, bounds = _word_hashes(texts[piece])
        full = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width if len(full) else 0):
            full += mix64(words[k : k + len(full)] + weights[k]) * weights[k]
        full = mix64(full)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            n = hi - lo
            if n >= width:
                sets.append(np.unique(full[lo : hi - width + 1]))
            elif n:
                short = (mix64(words[lo:hi] + weights[:n]) * weights[:n]).sum(dtype=np.uint64)
                sets.append(mix64(np.array([short + np.uint64(n)], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets
