"""Cross-tokenizer alignment against spans compared one by one."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from updraft.llm import alignment, lockstep
from updraft.llm.common import table

SF = "/root/testdata/sf0.001"
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _spans(ids, pieces):
    at, found = 0, []
    for i in ids:
        found.append((at, at + len(pieces[i])))
        at += len(pieces[i])
    return found


def brute(rows):
    """rows: (key, text) with distinct keys; key -> the numbers of the contract."""
    side_a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    side_a.encode_special_tokens = True
    side_b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as source:
        bytes_a = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, source)}
    names = [side_b.id_to_piece(i) for i in range(side_b.get_piece_size())]
    bytes_b = [bytes([int(n[3:5], 16)]) if side_b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    found, counts = {}, Counter()
    for key, text in rows:
        found[key] = (0, 0, 0, [], "")
        if not text:
            continue
        a, b = side_a.encode(" " + text, add_special_tokens=False).ids, side_b.encode(text)
        spans_a, spans_b = _spans(a, bytes_a), _spans(b, bytes_b)
        if not b"".join(bytes_a[i] for i in a) == (" " + text).encode() == b"".join(bytes_b[i] for i in b):
            continue
        groups, last = [], 0
        for end in sorted({e for _, e in spans_a} & {e for _, e in spans_b}):
            inside = lambda ids, spans: ",".join(str(i) for i, (s, e) in zip(ids, spans) if last <= s and e <= end)  # noqa: B023, E731
            groups.append(f"{inside(a, spans_a)}|{inside(b, spans_b)}")
            last = end
        links = [(i, j) for i, (s, e) in zip(a, spans_a) for j, (t, f) in zip(b, spans_b) if s < f and t < e]
        counts.update(links)
        found[key] = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return {
        k: (a, b, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha)
        for k, (a, b, g, links, sha) in found.items()
    }


EDGES = [
    (None, "lonely row"), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "a <|endoftext|> b <s> </s> <0x41>"), (2**53 + 1, " \t\n  x  "),
    (10**6 + 3, "▁"), (10**6 + 4, "😀 é ﬁ 中文 \x00"), (10**6 + 5, "the same words " * 60), (10**6 + 6, " "),
]


def test_documents_and_edges(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").where("length(text) < 2000").union(spark.createDataFrame(EDGES, "doc_id long, text string"))
    want = brute([tuple(r) for r in docs.collect()])
    got = {r.doc_id: tuple(r[n] for n in NUMBERS) for r in alignment.aligned(docs.selectExpr("*", "'x' AS place", "1 AS n_a")).collect()}
    assert got == want
    assert want[10**6 + 2][0] > 0 and want[10**6 + 3] == (0, 0, 0, 0, 0, 0, "") and want[None][3] > 0


def test_chunks_and_batches_do_not_matter(spark, monkeypatch):
    docs = table(spark, SF, "documents").select("doc_id", "text").limit(40)
    want = sorted(map(tuple, alignment.aligned(docs).collect()))
    assert sorted(map(tuple, alignment.aligned(docs.repartition(7)).collect())) == want


def test_repeated_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "three")], "doc_id long, text string")
    got = sorted((r.n_links, r.count_sum) for r in alignment.aligned(docs).collect())
    assert len(got) == 3 and got[-1] == got[-2]
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lockstep_with_and_without_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    for piece in (4, 10**9):
        monkeypatch.setattr(lockstep, "PIECE", piece)
        for _ in range(30):
            total = np.cumsum(rng.integers(1, 60, 5))
            ends = [np.union1d(total, rng.integers(1, total[-1] + 1, rng.integers(1, 80))) for _ in range(2)]
            first = np.concatenate([[0], np.searchsorted(ends[0], total) + 1])
            found = lockstep.align(*ends, first)
            starts = [np.concatenate([[0], e[:-1]]) for e in ends]
            want = {(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]}
            assert set(zip(found.link_a.tolist(), found.link_b.tolist())) == want and len(found.link_a) == len(want)
            common = np.intersect1d(*ends)
            assert (ends[0][found.cut_a] == common).all() and (ends[1][found.cut_b] == common).all()
