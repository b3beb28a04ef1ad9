"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A piece goes to the window
it fits best; when it fits none, the fullest window is emitted. A window that
would be emitted with a gap over ``max_gap`` is first topped up with the head of
the piece. The windows still open at the end of a partition are merged in a
second pass over all partitions' leftovers; what remains open there is emitted
in lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updraft.llm import tokens
from updraft.llm.common import cut_lineage, map_exact

LENGTH = 1024
OPEN_WINDOWS = 64
#: Padding that is accepted rather than cutting a document once more.
MAX_GAP = 8
#: Leftover windows, on average, that one task of the second pass merges.
MERGED_WINDOWS = 4096
_WIDTH = tokens.ID_TYPE.itemsize
#: Sequence ids: pass, partition, number within the partition.
_PASS, _PART = 1 << 60, 1 << 32

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "ids binary, open boolean"
)


@dataclass
class Piece:
    doc_id: str | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // _WIDTH

    def cut(self, n: int) -> tuple[Piece, Piece]:
        head, rest = self.ids[: n * _WIDTH], self.ids[n * _WIDTH :]
        return Piece(self.doc_id, self.start, head, self.doc_tokens), Piece(self.doc_id, self.start + n, rest, self.doc_tokens)


@dataclass
class Open:
    """The open windows of a partition, ordered by the room they have left."""

    length: int = LENGTH
    limit: int = OPEN_WINDOWS
    max_gap: int = MAX_GAP
    rooms: list[tuple[int, int]] = field(default_factory=list)
    windows: dict[int, list[Piece]] = field(default_factory=dict)
    made: int = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Places a piece and yields every window that is thereby finished."""
        while len(piece) > self.length:
            head, piece = piece.cut(self.length)
            yield [head]
        while True:
            at = bisect_left(self.rooms, (len(piece), -1))
            if at < len(self.rooms):
                room, key = self.rooms.pop(at)
                self.windows[key].append(piece)
                if room == len(piece):
                    yield self.windows.pop(key)
                else:
                    insort(self.rooms, (room - len(piece), key))
                return
            if len(piece) == self.length:
                yield [piece]
                return
            if len(self.rooms) < self.limit:
                self.made += 1
                self.windows[self.made] = [piece]
                insort(self.rooms, (self.length - len(piece), self.made))
                return
            room, key = self.rooms.pop(0)
            fullest = self.windows.pop(key)
            if room > self.max_gap:
                head, piece = piece.cut(room)
                fullest.append(head)
            yield fullest

    def rest(self) -> Iterator[list[Piece]]:
        yield from self.windows.values()


def binary_lengths(window: list[Piece]) -> Iterator[list[Piece]]:
    """Cuts a window into sequences whose lengths are powers of two."""
    left = sum(map(len, window))
    pieces = list(window)
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        taken = []
        while want:
            piece = pieces.pop(0)
            if len(piece) > want:
                piece, rest = piece.cut(want)
                pieces.insert(0, rest)
            want -= len(piece)
            taken.append(piece)
        yield taken


def _rows(numbered: list[tuple[int, list[Piece]]], still_open: bool) -> pd.DataFrame:
    rows = []
    for number, window in numbered:
        offset = 0
        for p in window:
            ids = p.ids if still_open else None
            rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, number, offset, ids, still_open))
            offset += len(p)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pd.DataFrame(rows, columns=names)


def _first_pass(path: str, length: int, limit: int):
    end = np.array([tokens.END_ID], tokens.ID_TYPE).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, number, part = Open(length, limit), 0, 0
        for batch in batches:
            if not len(batch):
                continue
            part = int(batch["part"].iloc[0]) * _PART
            done = []
            for doc_id, body in zip(batch["doc_id"], tokens.encode_all(path, batch["text"].tolist()), strict=True):
                body += end
                whole = Piece(doc_id, 0, body, len(body) // _WIDTH)
                for window in state.add(whole):
                    done.append((part + number, window))
                    number += 1
            yield _rows(done, False)
        # Waiting workers would hold the words of all their tasks next to those at work.
        tokens.forget(path)
        yield _rows([(part + number + i, w) for i, w in enumerate(state.rest())], True)

    return run


def _second_pass(length: int, limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, number, part = Open(length, limit), 0, 0
        for batch in batches:
            if not len(batch):
                continue
            part = _PASS + int(batch["part"].iloc[0]) * _PART
            done = []
            for doc_id, start, ids, total in zip(batch["doc_id"], batch["start"], batch["ids"], batch["doc_tokens"], strict=True):
                piece = Piece(doc_id, int(start), bytes(ids), int(total))
                for window in state.add(piece):
                    done.append((part + number, window))
                    number += 1
            yield _rows(done, False)
        last = [sequence for window in state.rest() for sequence in binary_lengths(window)]
        yield _rows([(part + number + i, w) for i, w in enumerate(last)], False)

    return run


def pack(docs: DataFrame, length: int = LENGTH, open_windows: int = OPEN_WINDOWS, path: str | None = None) -> DataFrame:
    """One row per piece of a document of ``docs`` (doc_id, text).

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    A null or empty text is its end id alone; repeated rows and null ids are
    packed like any others. An empty table gives an empty result; other columns
    are ignored. ``length`` is a power of two.
    """
    path = path or tokens.vocabulary_path()
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("part"))
    first = cut_lineage(map_exact(rows, _first_pass(path, length, open_windows), SCHEMA, "doc_id"), "packed")
    left = first.where("open")
    tasks = max(1, -(-left.select("sequence_id").distinct().count() // MERGED_WINDOWS))
    # Largest pieces first within a task, as best fit likes them; the order is total up to equal rows.
    dealt = left.repartition(tasks, "sequence_id", "offset").sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32")
    dealt = dealt.withColumn("part", F.spark_partition_id())
    merged = map_exact(dealt, _second_pass(length, open_windows), SCHEMA, "doc_id")
    return first.where("NOT open").unionByName(merged).drop("ids", "open")
