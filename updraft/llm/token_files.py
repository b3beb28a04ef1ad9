"""Binary token files: concatenated ids with Elias-Fano document boundaries.

A file is the magic text, the bytes per id, three lengths, then the ids as
little-endian unsigned integers (two bytes each while the vocabulary allows it),
the boundaries and the document numbers. Both of the latter are Elias-Fano coded, so no table of 64-bit offsets exists. Documents lie in
ascending order of their id, within each file and from file to file.

Files are written by the tasks straight to the shared folder. An attempt uses a
name of its own and only the committed manifest names the files that count, so
a lost executor or a second attempt leaves nothing but an unnamed file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from updraft.llm import tokens
from updraft.llm.common import cut_lineage, scratch_path
from updraft.llm.elias_fano import EliasFano

MAGIC = b"TOKIDS01"
_LENGTHS = struct.Struct("<B3Q")
#: Ids after which a task closes its file and opens the next one.
FILE_IDS = 4_000_000
#: Documents that have no id stand before all others, under this number.
NO_ID = -(1 << 62)
#: Files for a reader task, so that its start is small beside its work, and reader tasks at most.
FILES_READ, READERS = 4, 20_000


def narrow(ids: np.ndarray) -> np.ndarray:
    return ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids


def pack_file(ids: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> bytes:
    """``ends``: ids up to and with each document; ``numbers``: ascending document numbers."""
    ids = narrow(ids)
    width, body = ids.itemsize, ids.tobytes()
    least = int(numbers[0]) if len(numbers) else 0
    boundaries = EliasFano.encode(ends).to_bytes()
    docs = struct.pack("<q", least) + EliasFano.encode(numbers - least).to_bytes()
    return MAGIC + _LENGTHS.pack(width, len(body), len(boundaries), len(docs)) + body + boundaries + docs


def unpack_file(data: bytes) -> tuple[np.ndarray, EliasFano, tuple[int, EliasFano]]:
    """The ids, the boundaries with their select, and the document numbers as the least one and what others add."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    width, *sizes = _LENGTHS.unpack_from(data, len(MAGIC))
    at = np.cumsum([len(MAGIC) + _LENGTHS.size, *sizes])
    if at[-1] != len(data):
        raise ValueError("token file is cut short")
    docs = data[at[2] : at[3]]
    numbers = struct.unpack_from("<q", docs)[0], EliasFano.from_bytes(docs[8:])
    return np.frombuffer(data[at[0] : at[1]], f"<u{width}"), EliasFano.from_bytes(data[at[1] : at[2]]), numbers


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _writer(folder: str, path: str):
    end = np.array([tokens.END_ID], tokens.ID_TYPE).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        task = uuid.uuid4().hex
        ids, ends, numbers, files = [], [], [], 0

        def close() -> pd.DataFrame:
            name = f"{task}-{files:05d}.ids"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(pack_file(np.concatenate(ids), np.array(ends, np.int64), np.array(numbers, np.int64)))
            row = {"file": name, "part": part, "place": files, "n_docs": len(ends), "n_ids": ends[-1]}
            ids.clear(), ends.clear(), numbers.clear()
            return pd.DataFrame([row])

        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else 0
            for number, body in zip(batch["number"], tokens.encode_all(path, batch["text"].tolist()), strict=True):
                # Two bytes an id in memory too, as the file will mostly have them.
                ids.append(narrow(np.frombuffer(body + end, tokens.ID_TYPE)))
                ends.append((ends[-1] if ends else 0) + len(body) // tokens.ID_TYPE.itemsize + 1)
                numbers.append(int(number))
                if ends[-1] >= FILE_IDS:
                    yield close()
                    files += 1
        if ends:
            yield close()

    return run


def write_files(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Writes the token files of ``docs`` (doc_id, text) below ``folder``.

    Returns the committed manifest: file, part and place (which order the files),
    n_docs, n_ids. Null texts count as empty; rows with a null id come first and
    repeated ids stand side by side.
    """
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(number.alias("number"), "text")
    # The text decides among repeated ids, so that reruns write equal files.
    dealt = rows.repartitionByRange("number", F.crc32(F.col("text").cast("binary")))
    ordered = dealt.sortWithinPartitions("number", F.crc32(F.col("text").cast("binary")), "text")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    schema = "file string, part int, place int, n_docs long, n_ids long"
    return cut_lineage(ordered.mapInPandas(_writer(folder, path or tokens.vocabulary_path()), schema), "manifest")


def _reader(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        for batch in batches:
            for name, before in zip(batch["file"], batch["before"], strict=True):
                with store.open_input_file(f"{root}/{name}") as source:
                    ids, ends, (least, added) = unpack_file(source.read())
                at = 0
                for stops, more in zip(ends.runs(), added.runs(), strict=True):
                    starts, numbers = np.concatenate([[at], stops[:-1]]), more + least
                    at = int(stops[-1])
                    yield pd.DataFrame({
                        "doc_id": pd.array(numbers, "Int64") if NO_ID not in numbers
                        else pd.array([None if n == NO_ID else n for n in numbers], "Int64"),
                        "start": starts + before,
                        "n_tokens": stops - starts,
                        "ids_crc32": [zlib.crc32(ids[a:b].astype(tokens.ID_TYPE).tobytes()) for a, b in zip(starts, stops, strict=True)],
                    })

    return run


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32.

    The manifest has one row per some million ids; its running sum is the only
    step in one task. Boundaries come from the sampled select, a block at a time.
    Reader tasks grow with the files, one for ``FILES_READ``, ``READERS`` at most.
    """
    readers = max(1, min(READERS, -(-manifest.count() // FILES_READ)))
    order = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    spread = placed.select("file", "before").repartition(readers, "file")
    return spread.mapInPandas(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def document_ids(data: bytes, i: int) -> np.ndarray:
    """Ids of document ``i`` of one file, found by two selects."""
    ids, ends, _ = unpack_file(data)
    return ids[ends.select(i - 1) if i else 0 : ends.select(i)]


def round_trip(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the files of ``docs`` and returns what they hold, one row per document.

    An empty table writes no file and gives an empty result; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    return read_files(write_files(docs, folder), folder)
