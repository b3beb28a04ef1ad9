"""Two tokenisations of the same bytes merged in lockstep.

All texts of a batch lie one behind the other on one line of bytes. A state
vector holds, for every stretch of that line at once, a pointer to an A token and
one to a B token that overlap. A step emits the link of each pair of pointers and
advances whichever token ends first, or both where they end together, which is a
cut between two groups. Stretches that reach their end leave the vector.

A stretch is a text, or a piece of a long one: pieces start where both kinds of
tokens end together, looked for near regular marks only, so the number of steps
follows the length of a piece and not that of the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A tokens between two marks, and those after a mark that are searched for a common end.
PIECE, WINDOW = 512, 32


@dataclass
class Alignment:
    """Links as pairs of token numbers; the flags are set at tokens that end a group."""

    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def _starts(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray) -> np.ndarray:
    """A tokens that begin a stretch: the first of each text, and some with a common end just before."""
    marks = np.concatenate([np.arange(lo + PIECE, hi, PIECE) for lo, hi in zip(first_a[:-1], first_a[1:], strict=True)] or [[]])
    if not len(marks):
        return first_a[:-1]
    near = marks.astype(np.int64)[:, None] + np.arange(WINDOW)
    inside = near < len(ends_a) - 1
    ends = ends_a[np.where(inside, near, 0)]
    at = np.minimum(np.searchsorted(ends_b, ends), len(ends_b) - 1)
    common = inside & (ends_b[at] == ends)
    hit = common.any(axis=1)
    return np.union1d(first_a[:-1], near[hit, common.argmax(axis=1)[hit]] + 1)


def align(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray) -> Alignment:
    """``ends_*``: where each token ends on the line of bytes, ascending, no token being empty;
    ``first_a``: number of each text's first A token, then the number of all A tokens. Texts hold
    the same bytes in both kinds and at least one of them."""
    starts = _starts(ends_a, ends_b, first_a)
    stops = np.concatenate([starts[1:], [len(ends_a)]])
    at_a = starts.copy()
    before = np.where(at_a > 0, ends_a[np.maximum(at_a, 1) - 1], 0)
    at_b = np.searchsorted(ends_b, before, side="right")
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    links_a, links_b = [], []
    while len(at_a):
        links_a.append(at_a)
        links_b.append(at_b)
        end_a, end_b = ends_a[at_a], ends_b[at_b]
        step_a, step_b = end_a <= end_b, end_b <= end_a
        both = step_a & step_b
        cut_a[at_a[both]] = True
        cut_b[at_b[both]] = True
        at_a, at_b = at_a + step_a, at_b + step_b
        live = at_a < stops
        if not live.all():
            at_a, at_b, stops = at_a[live], at_b[live], stops[live]
    nothing = np.zeros(0, np.int64)
    return Alignment(np.concatenate([nothing, *links_a]), np.concatenate([nothing, *links_b]), cut_a, cut_b)
