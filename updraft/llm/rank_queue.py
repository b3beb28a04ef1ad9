"""Merging of byte pairs through a queue of ranks.

The queue is a bitmap in two levels over one bucket of list positions per rank.
Bit ``r`` of the lower level is set while the bucket of rank ``r`` holds a
position; a bit of the upper level says that a word below it has any bit set. The
next rank takes one find-first-set per level, whatever the queue holds, so a
merge costs the same in a word of ten bytes and in one of ten million.
"""

from __future__ import annotations

from heapq import heappop, heappush

#: A bitmap word has 512 bits; two levels cover 2**18 ranks.
SHIFT, MASK = 9, 511
_NONE = -1
_BITS = [1 << i for i in range(MASK + 1)]


class PairMerger:
    """``ranks``: token bytes to rank, which is also the token's id; holds every single byte."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        most = max(ranks.values())
        if most >> 2 * SHIFT:
            raise ValueError("too many ranks for two levels")
        self._low = [0] * ((most >> SHIFT) + 1)
        self._buckets: list[list[int]] = [[] for _ in range(most + 1)]
        self._bytes = [ranks[bytes([b])] for b in range(256)]
        # Two neighbouring tokens in one number, and the token they make; every way to cut a token counts.
        self._width = most.bit_length()
        self._pairs = {
            ranks[token[:at]] << self._width | ranks[token[at:]]: rank
            for token, rank in ranks.items()
            for at in range(1, len(token))
            if token[:at] in ranks and token[at:] in ranks
        }
        self._first = [[self._pairs.get(a << self._width | b, _NONE) for b in self._bytes] for a in self._bytes]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match: the lowest rank merges first, leftmost first."""
        n, width = len(piece), self._width
        pairs, buckets, low, bits, top = self._pairs.get, self._buckets, self._low, _BITS, 0
        ids = list(map(self._bytes.__getitem__, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self._first
        waiting = [first[a][b] for a, b in zip(piece, piece[1:])]  # the present rank of the pair that begins here
        waiting.append(_NONE)
        for i, rank in enumerate(waiting):
            if rank != _NONE:
                bucket = buckets[rank]
                if bucket:
                    heappush(bucket, i)
                else:
                    bucket.append(i)
                    word = rank >> SHIFT
                    if not low[word]:
                        top |= bits[word]
                    low[word] |= bits[rank & MASK]
        while top:
            word = (top & -top).bit_length() - 1
            here = low[word]
            rank = word << SHIFT | (here & -here).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket.pop()
                low[word] = here = here & (here - 1)
                if not here:
                    top &= top - 1
            if waiting[i] != rank:
                continue  # stale: a merge has changed the pair since it was put here
            gone = after[i]
            after[i] = right = after[gone]
            ids[i] = rank
            waiting[gone] = _NONE
            if right < n:
                before[right] = i
                waiting[i] = new = pairs(rank << width | ids[right], _NONE)
                if new != _NONE:
                    bucket = buckets[new]
                    if bucket:
                        heappush(bucket, i)
                    else:
                        bucket.append(i)
                        word = new >> SHIFT
                        if not low[word]:
                            top |= bits[word]
                        low[word] |= bits[new & MASK]
            else:
                waiting[i] = _NONE
            left = before[i]
            if left >= 0:
                waiting[left] = new = pairs(ids[left] << width | rank, _NONE)
                if new != _NONE:
                    bucket = buckets[new]
                    if bucket:
                        heappush(bucket, left)
                    else:
                        bucket.append(left)
                        word = new >> SHIFT
                        if not low[word]:
                            top |= bits[word]
                        low[word] |= bits[new & MASK]
        found, i = [], 0
        while i < n:
            found.append(ids[i])
            i = after[i]
        return found
