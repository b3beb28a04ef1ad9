"""Which tokens of two tokenizers cover the same bytes, over whole documents and over the corpus.

One pass encodes each text both ways, aligns the tokens in lockstep and keeps,
per chunk of documents, one row: what the documents need later as a compressed
Arrow table, and the chunk's distinct id pairs with their number of links. Pairs
are added up over all chunks and come back to the chunks that hold them, at most
one row per chunk and pair, so that a pair found in every document weighs no more
than a rare one. A second pass over the chunk rows scores each document's links.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import public_tokenizers  # noqa: E402
from sentencepiece import SentencePieceProcessor  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from updraft.llm import tokens  # noqa: E402
from updraft.llm.common import cut_lineage, in_pieces, ship  # noqa: E402
from updraft.llm.lockstep import align  # noqa: E402

VOCABULARY_A, VOCABULARY_B = tokens.VOCABULARY, "piece_bpe_32k.model"
#: Characters of a chunk; a longer text is a chunk of its own.
CHUNK_CHARS = 1 << 21
#: An id pair is one number, B's id in the low bits.
B_BITS = 20
#: Between the digits of a group's ids, between A and B, between groups.
_COMMA, _BAR, _SEMICOLON = ",|;"


@dataclass
class Coder:
    """Ids of texts under one vocabulary, and each id's bytes."""

    encode: object
    pieces: list[bytes]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)


@cache
def coder_a(path: str) -> Coder:
    """Byte-level BPE; names of special tokens in a text are plain text."""
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    changed = tokens._byte_letters()
    letters = {changed.get(b, chr(b)): b for b in range(256)}
    pieces = [b""] * plain.get_vocab_size()
    for token, i in plain.get_vocab().items():
        pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    names = [t.content for t in plain.get_added_tokens_decoder().values()]

    def encode(texts: list[str]) -> list[np.ndarray]:
        # The word cache knows such names as tokens of their own, so texts with one go another way.
        special = [i for i, t in enumerate(texts) if any(n in t for n in names)]
        found = [np.frombuffer(b, tokens.ID_TYPE) for b in tokens.encode_all(path, texts)] if len(special) < len(texts) else [None] * len(texts)
        for i in special:
            found[i] = np.array(plain.encode(texts[i], add_special_tokens=False).ids, tokens.ID_TYPE)
        return found

    return Coder(encode, pieces)


@cache
def coder_b(path: str) -> Coder:
    """Pieces with byte fallback; the model puts a space before the text."""
    model = SentencePieceProcessor(model_file=path)

    def piece(i: int) -> bytes:
        name = model.id_to_piece(i)
        return bytes([int(name[3:-1], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, tokens.ID_TYPE) for ids in model.encode(texts, num_threads=1)]

    return Coder(encode, [piece(i) for i in range(model.get_piece_size())])


@cache
def _digits(n_a: int, n_b: int) -> list[str]:
    """Texts of all ids with what follows them: A ids within and at the end of a group, then B ids."""
    a = [f"{i}{sign}" for i in range(n_a) for sign in (_COMMA, _BAR)]
    return a + [f"{i}{sign}" for i in range(n_b) for sign in (_COMMA, _SEMICOLON)]


def group_text(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, n_a: int, n_b: int) -> str:
    """``a1,a2|b1;a3|b2,b3`` for the ids and group ends of one document."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    sizes_a, sizes_b = np.bincount(group_a), np.bincount(group_b)
    words = np.empty(len(a) + len(b), np.int64)
    # Before an A token stand the B tokens of earlier groups; before a B token, the A tokens up to its own.
    words[np.arange(len(a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]] = a.astype(np.int64) * 2 + cut_a
    words[np.arange(len(b)) + np.cumsum(sizes_a)[group_b]] = b.astype(np.int64) * 2 + cut_b + 2 * n_a
    return "".join(map(_digits(n_a, n_b).__getitem__, words.tolist()))[:-1]


@dataclass
class Aligned:
    """Numbers of each text, and the links of all of them: their text's number and their id pair."""

    rows: list[tuple[int, int, int, int, str]]  # n_a, n_b, n_groups, n_links, groups
    link_text: np.ndarray
    link_pair: np.ndarray


def align_texts(texts: list[str | None], a: Coder, b: Coder) -> Aligned:
    """Texts that are null, empty, or whose bytes one side does not give back have no tokens."""
    rows: list = [(0, 0, 0, 0, "")] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    ids_a = a.encode([" " + texts[i] for i in full])
    ids_b = b.encode([texts[i] for i in full])
    used = []
    for k, i in enumerate(full):
        whole = b" " + texts[i].encode("utf-8", "surrogatepass")
        if all(b"".join(map(c.pieces.__getitem__, ids[k].tolist())) == whole for c, ids in ((a, ids_a), (b, ids_b))):
            used.append(k)
    if not used:
        return Aligned(rows, np.zeros(0, np.int64), np.zeros(0, np.int64))
    first_a = np.concatenate([[0], np.cumsum([len(ids_a[k]) for k in used])])
    first_b = np.concatenate([[0], np.cumsum([len(ids_b[k]) for k in used])])
    all_a, all_b = (np.concatenate([ids[k] for k in used]) for ids in (ids_a, ids_b))
    found = align(np.cumsum(a.sizes[all_a]), np.cumsum(b.sizes[all_b]), first_a)
    place = np.searchsorted(first_a, found.link_a, side="right") - 1
    links = np.bincount(place, minlength=len(used))
    for j, k in enumerate(used):
        on_a, on_b = slice(first_a[j], first_a[j + 1]), slice(first_b[j], first_b[j + 1])
        cut_a, cut_b = found.cut_a[on_a], found.cut_b[on_b]
        text = group_text(all_a[on_a], all_b[on_b], cut_a, cut_b, len(a.pieces), len(b.pieces))
        digest = hashlib.sha256(text.encode()).hexdigest()
        rows[full[k]] = (len(cut_a), len(cut_b), int(cut_a.sum()), int(links[j]), digest)
    pair = all_a[found.link_a].astype(np.int64) << B_BITS | all_b[found.link_b]
    return Aligned(rows, np.array([full[k] for k in used])[place], pair)


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _packed(doc_ids: list, found: Aligned) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The chunk's documents as an Arrow table, its distinct pairs and their number of links."""
    pairs, inverse = np.unique(found.link_pair, return_inverse=True)
    # Distinct pairs of each document, by their place in ``pairs``.
    own, times = np.unique(found.link_text * max(len(pairs), 1) + inverse, return_counts=True)
    text, place = np.divmod(own, max(len(pairs), 1))
    ends = np.searchsorted(text, np.arange(len(doc_ids) + 1)).astype(np.int32)
    columns = dict(zip(_NUMBERS, zip(*found.rows, strict=True), strict=True))
    documents = pa.table({
        "doc_id": pa.array(doc_ids, pa.string()),
        **{name: pa.array(values) for name, values in columns.items()},
        "place": pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))),
        "times": pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
    })
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(documents)
    return sink.getvalue().to_pybytes(), pairs, np.bincount(inverse, minlength=len(pairs))


def _chunks(path_a: str, path_b: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = coder_a(path_a), coder_b(path_b)
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch["text"].tolist()
            for part in in_pieces([t or "" for t in texts], CHUNK_CHARS):
                documents, pairs, links = _packed(batch["doc_id"].iloc[part].tolist(), align_texts(texts[part], a, b))
                yield pd.DataFrame({"task": [task], "chunk": [n], "documents": [documents], "pairs": [pairs], "links": [links]})
                n += 1

    return run


def pair_counts(chunks: DataFrame) -> DataFrame:
    """a_id, b_id, links (corpus-wide) and best (no A id has more links with this B id)."""
    rows = chunks.select(F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("p.pairs", "p.links")
    sums = rows.groupBy("pairs").agg(F.sum("links").alias("links"))
    ids = sums.select(F.shiftright("pairs", B_BITS).alias("a_id"), F.col("pairs").bitwiseAND((1 << B_BITS) - 1).alias("b_id"), "links")
    ids = cut_lineage(ids, "pairs")
    most = ids.groupBy("b_id").agg(F.max("links").alias("most"))
    return ids.join(most, "b_id").select("a_id", "b_id", "links", (F.col("links") == F.col("most")).alias("best"))


def _scored():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for documents, totals, best in zip(batch["documents"], batch["totals"], batch["best"], strict=True):
                table = pa.ipc.open_stream(documents).read_all().combine_chunks()
                place, times = (table[c].combine_chunks() for c in ("place", "times"))
                ends = np.asarray(place.offsets)
                place, times = np.asarray(place.values), np.asarray(times.values).astype(np.int64)
                found = table.select(["doc_id", *_NUMBERS]).to_pandas()
                for name, worth in (("n_best", best), ("count_sum", totals)):
                    if len(place):
                        sums = np.concatenate([[0], np.cumsum(np.asarray(worth, np.int64)[place] * times)])
                        found[name] = sums[ends[1:]] - sums[ends[:-1]]
                    else:
                        found[name] = 0
                yield found

    return run


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null or empty, or that one of the tokenizers does not give back
    byte for byte, has zeros and an empty digest. Null and repeated ids stay as
    they are; an empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    path_a, path_b = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    schema = "task int, chunk int, documents binary, pairs array<long>, links array<long>"
    chunks = cut_lineage(rows.mapInPandas(_chunks(path_a, path_b), schema), "chunks")
    counts = pair_counts(chunks).select(
        (F.shiftleft("a_id", B_BITS).bitwiseOR(F.col("b_id"))).alias("pair"), "links", F.col("best").cast("int").alias("best")
    )
    held = chunks.select("task", "chunk", F.posexplode("pairs").alias("place", "pair")).join(counts, "pair")
    # As many entries as the chunk has distinct pairs, in their order there.
    back = held.groupBy("task", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "links", "best"))).alias("p"))
    back = back.select("task", "chunk", F.col("p.links").alias("totals"), F.col("p.best").alias("best"))
    scored = chunks.select("task", "chunk", "documents").join(back, ["task", "chunk"], "left")
    scored = scored.select("documents", F.coalesce("totals", F.array().cast("array<long>")).alias("totals"), F.coalesce("best", F.array().cast("array<int>")).alias("best"))
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    schema = "doc_id string, " + ", ".join(f"{n} long" for n in numbers) + ", groups_sha256 string, n_best long, count_sum long"
    found = scored.mapInPandas(_scored(), schema)
    return found.select(F.col("doc_id").cast("long"), *numbers, "n_best", "count_sum", "groups_sha256")
