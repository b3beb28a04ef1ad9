"""Geometric near-neighbour access tree over a codebook, searched exactly.

A node picks split points far apart and gives every other entry to its nearest
one. For each pair of a split point and a child the node stores the range of
distances from that point to the child's entries. A query measures its distance
to the split points; the triangle inequality then bounds its distance to all of a
child's entries from below. A child is dropped only if that bound, rounded down,
lies strictly above the best distance so far, so entries at equal distance
survive. What is left is compared in whole numbers; ties go to the lower index.

Queries go down the tree together: each node handles all that still need it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Split points of a node; nodes of up to ``LEAF`` entries are compared one by one.
SPLITS, LEAF = 6, 8
#: Taken off each bound, relative to the distances in it: far more than rounding can add.
ROUNDING = 1e-9


def _squares(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    gap = points - entry
    return np.einsum("ij,ij->i", gap, gap)


@dataclass
class Node:
    entries: np.ndarray  # indexes of the split points, or of all entries of a leaf
    children: list["Node | None"] = field(default_factory=list)
    least: np.ndarray | None = None  # [child, split point] distances
    most: np.ndarray | None = None


class Gnat:
    """``codebook``: one row of whole numbers per entry. ``measured`` counts distances that were computed."""

    def __init__(self, codebook: np.ndarray) -> None:
        self.codebook = np.asarray(codebook, np.int64)
        self.measured = 0
        self.root = self._build(np.arange(len(self.codebook)))

    def _build(self, entries: np.ndarray) -> Node:
        points = self.codebook[entries]
        if len(entries) <= LEAF:
            return Node(entries)
        # The first entry, then always the one farthest from all split points so far.
        splits = [0]
        gaps = [_squares(points, points[0])]
        while len(splits) < SPLITS:
            far = np.min(gaps, axis=0)
            if not far.max():
                break
            splits.append(int(far.argmax()))
            gaps.append(_squares(points, points[splits[-1]]))
        if len(splits) == 1:
            return Node(entries)  # all equal
        gaps = np.array(gaps)
        owner = gaps.argmin(axis=0)
        inner = np.ones(len(entries), bool)
        inner[splits] = False
        distance = np.sqrt(gaps.astype(float))
        children, least, most = [], [], []
        for k in range(len(splits)):
            own = (owner == k) & inner
            children.append(self._build(entries[own]) if own.any() else None)
            within = distance[:, own] if own.any() else np.zeros((len(splits), 1))
            least.append(within.min(axis=1))
            most.append(within.max(axis=1))
        return Node(entries[splits], children, np.array(least), np.array(most))

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance for each query."""
        queries = np.asarray(queries, np.int64)
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.zeros(len(queries), np.int64)
        if len(queries):
            self._visit(self.root, queries, np.arange(len(queries)), best, index)
        return index, best

    def _visit(self, node: Node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        here = queries[rows]
        squares = np.empty((len(node.entries), len(rows)), np.int64)
        for k, entry in enumerate(node.entries):
            squares[k] = found = _squares(here, self.codebook[entry])
            better = (found < best[rows]) | ((found == best[rows]) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = found[better], entry
        self.measured += squares.size
        if not node.children:
            return
        distance = np.sqrt(squares.astype(float))
        first = squares.argmin(axis=0)
        # Bounds do not change on the way; what they are compared with does.
        bounds = []
        for k, child in enumerate(node.children):
            low = np.maximum(distance - node.most[k][:, None], node.least[k][:, None] - distance)
            slack = ROUNDING * (1 + distance + node.most[k][:, None])
            bounds.append(None if child is None else (low - slack).max(axis=0))
        for near in (True, False):
            for k, child in enumerate(node.children):
                if child is None:
                    continue
                mine = (first == k) == near
                mine &= bounds[k] <= np.sqrt(best[rows].astype(float))
                if mine.any():
                    self._visit(child, queries, rows[mine], best, index)
