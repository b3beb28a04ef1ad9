"""Language of whole texts by sparse multinomial logistic regression.

Features are hashed character n-grams weighted by TF-IDF: the share of an n-gram
among those of its text, times the log of the inverse share of texts with it.
Document frequencies cover every text one may learn from. The weights are fitted
by follow-the-regularised-leader with an elastic net, which leaves most of them
exactly zero, and the scores are calibrated by one temperature.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updraft.llm.common import cut_lineage, held_out, mix64, seeded, map_exact

SIZES = (1, 2, 3)
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
#: Labelled texts that the weights, and those that the temperature are fitted on, at most.
FIT_TEXTS, CALIBRATION_TEXTS = 4000, 1000
EPOCHS, BATCH = 3, 64
#: Follow-the-regularised-leader: learning rate, its offset, and the elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
#: Brings the feature values near one.
SCALE = 32.0
UNKNOWN = "und"
PIECE_CHARS = 1 << 18

_WORD_SIGN = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character of any letter category is there; signs such as superscripts and fractions are none."""
    return any(sign[0].isalpha() for sign in _WORD_SIGN.finditer(text))


def grams(text: str) -> np.ndarray:
    """Bucket of every n-gram of a text, over its code points in lower case."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found = []
    code = np.zeros(len(points), np.uint64)
    for size in range(1, max(SIZES) + 1):
        ahead = points[size - 1 :]
        code = code[: len(ahead)] * np.uint64(0x110000) + ahead
        if size in SIZES:
            found.append(mix64(code + np.uint64(size)) >> np.uint64(64 - BUCKET_BITS))
    return np.concatenate(found).astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their shares among its n-grams."""
    counts = np.bincount(grams(text), minlength=BUCKETS)
    buckets = np.flatnonzero(counts)
    return buckets, counts[buckets] / counts.sum()


@dataclass
class Model:
    langs: list[str]
    #: Row per bucket, column per language: weights times inverse document frequency.
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.langs)), 0
        for at in range(0, len(text), PIECE_CHARS):  # bounds the arrays, not the text
            # Pieces overlap by what an n-gram spans; the seam adds a few n-grams of its own.
            part = grams(text[max(0, at - max(SIZES) + 1) : at + PIECE_CHARS])
            total += self.weights[part].sum(axis=0)
            n += len(part)
        scores = (total * (SCALE / n) + self.bias) / self.temperature
        scores = np.exp(scores - scores.max())
        best = int(scores.argmax())
        return self.langs[best], float(scores[best] / scores.sum())


def _document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    texts, with_bucket = 0, np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch["text"]:
            with_bucket[np.unique(grams(text))] += 1
            texts += 1
    used = np.flatnonzero(with_bucket)
    yield pd.DataFrame({"bucket": np.append(used, -1), "n": np.append(with_bucket[used], texts)})


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


def fit_leader(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader, per coordinate and class."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def current(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    order = np.random.default_rng(17)
    for _ in range(EPOCHS):
        shuffled = order.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            picked = shuffled[start : start + BATCH]
            owner = np.repeat(np.arange(len(picked)), [len(rows[i][0]) + 1 for i in picked])
            at = np.concatenate([np.append(rows[i][0], BUCKETS) for i in picked])
            value = np.concatenate([np.append(rows[i][1], 1.0) for i in picked])
            used, where = np.unique(at, return_inverse=True)
            weights = current(used)
            scores = np.zeros((len(picked), classes))
            np.add.at(scores, owner, value[:, None] * weights[where])
            wrong = _softmax(scores)
            wrong[np.arange(len(picked)), target[picked]] -= 1
            gradient = np.zeros((len(used), classes))
            np.add.at(gradient, where, value[:, None] * wrong[owner] / len(picked) ** 0.5)
            grown = np.sqrt(n[used] + gradient**2) - np.sqrt(n[used])
            z[used] += gradient - grown / ALPHA * weights
            n[used] += gradient**2
    everything = current(np.arange(BUCKETS + 1))
    return everything[:-1], everything[-1]


def fit_temperature(scores: np.ndarray, target: np.ndarray) -> float:
    """Temperature of least log loss, by golden section over its logarithm.

    One more text of no known class is assumed, which keeps scores below
    certainty when all the calibration texts are told apart.
    """
    if not len(scores):
        return 1.0
    doubt = 1 / (len(scores) + 2)
    wanted = np.full(scores.shape, doubt / max(1, scores.shape[1] - 1))
    wanted[np.arange(len(target)), target] = 1 - doubt

    def loss(log_t: float) -> float:
        return -(wanted * np.log(np.maximum(_softmax(scores / math.exp(log_t)), 1e-12))).sum(axis=1).mean()

    lo, hi, ratio = math.log(0.05), math.log(50), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def _fitted(idf: dict[int, float]):
    """Fits on the bounded sample, in one task; returns the non-zero weights."""

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["pick", "doc_id"], kind="stable")
        langs = sorted(sample["lang"].unique())
        target = np.array([langs.index(v) for v in sample["lang"]])
        weight = np.zeros(BUCKETS)
        weight[list(idf)] = list(idf.values())
        rows = [(b, s * weight[b] * SCALE) for b, s in map(counted, sample["text"])]
        role = sample["role"].to_numpy()
        own, rest = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        weights, bias = fit_leader([rows[i] for i in own], target[own], len(langs))
        scores = np.array([v @ weights[b] + bias for b, v in (rows[i] for i in rest)]).reshape(len(rest), len(langs))
        temperature = fit_temperature(scores, target[rest])
        out = [(lang, -1, bias[k]) for k, lang in enumerate(langs)] + [("", -2, temperature)]
        for k, lang in enumerate(langs):
            used = np.flatnonzero(weights[:, k])
            out += zip([lang] * len(used), used.tolist(), (weights[used, k] * weight[used]).tolist(), strict=True)
        return pd.DataFrame(out, columns=["lang", "bucket", "value"])

    return run


def fit(docs: DataFrame) -> Model:
    """Learns from the rows of ``docs`` with a language that are not held out.

    The frequencies take in all of these rows. The weights and the temperature
    come from bounded samples of them, chosen by a hash of the id.
    """
    known = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = known.select("text").mapInPandas(_document_frequencies, "bucket int, n long")
    # At most one row per bucket comes to the driver.
    rows = dict(counts.groupBy("bucket").agg(F.sum("n")).collect())
    texts = rows.pop(-1, 0)
    if not texts:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    idf = {b: math.log((1 + texts) / (1 + n)) + 0.1 for b, n in rows.items()}
    size = FIT_TEXTS + CALIBRATION_TEXTS
    picked = known.select("doc_id", seeded(F.col("doc_id"), 31).alias("pick")).distinct().orderBy("pick", "doc_id").limit(size)
    # One in five calibrates. The sample has at most ``size`` ids.
    role = (F.pmod(F.col("pick"), F.lit(size)) < CALIBRATION_TEXTS).cast("int").alias("role")
    picked = cut_lineage(picked.select("doc_id", "pick", role), "picked")
    sample = known.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    found = sample.groupBy().applyInPandas(_fitted(idf), "lang string, bucket int, value double").collect()
    langs = sorted({r.lang for r in found if r.bucket == -1})
    weights, bias, temperature = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs)), 1.0
    for lang, bucket, value in found:
        if bucket == -2:
            temperature = value
        elif bucket == -1:
            bias[langs.index(lang)] = value
        else:
            weights[bucket, langs.index(lang)] = value
    return Model(langs, weights, bias, temperature)


def predicted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs`` (doc_id, text, lang).

    A null text, or one without a letter, is ``und`` with score 0; so is every
    text if nothing could be learned. A null id is not held out and cannot be
    learned from. Repeated rows pass like any others; other columns are ignored;
    an empty table gives an empty result.
    """
    model = model or fit(docs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS rows of one number per language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch["text"]]
            out = batch[["doc_id", "held_out"]].copy()
            out["lang_pred"], out["score"] = [f[0] for f in found], [f[1] for f in found]
            yield out

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_exact(rows, run, "doc_id long, held_out boolean, lang_pred string, score double", "doc_id")
