"""Quality scores by positive-unlabelled learning.

Trusted good texts are the positives, web text without a label is the rest. The
risk of a classifier on negatives is not seen directly: it is the risk of calling
the unlabelled texts negative, less the class prior times that of calling the
positives negative. That difference is kept from going below zero, which stops
the classifier from merely memorising the positives. The prior is estimated as
the share of good texts among the labelled ones.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from updraft.llm.common import cut_lineage, give_back, held_out, long_columns, map_exact, mix64, seeded, shielded, tidied

BUCKET_BITS = 10
BUCKETS = 1 << BUCKET_BITS
#: Lengths of the shape n-grams.
SIZES = (1, 2, 3, 4)
#: Texts that the model is fitted on, at most.
POSITIVES, UNLABELLED = 3000, 6000
STEPS, BATCH, RATE, DECAY = 800, 512, 0.05, 1e-4
#: Share of a step that takes the negative risk back above zero.
BACK = 1.0
PIECE_CHARS = 1 << 18
N_DENSE = 7


def _classes() -> np.ndarray:
    """Shape of each of the first 0x250 code points: one for each kind of letter, digits, blanks, and each mark."""
    table = np.full(0x250, 3, np.uint64)
    for point in range(0x250):
        c = chr(point)
        if c.isalpha():
            table[point] = 1 if c.isupper() else 0
        elif c.isdigit():
            table[point] = 2
        elif c in "\n\r":
            table[point] = 4
        elif not c.isspace() and point < 0x80:
            table[point] = 8 + point
    return table


_CLASSES = _classes()
_OTHER = np.uint64(5)


def _shape_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    shape = np.where(points < len(_CLASSES), _CLASSES[np.minimum(points, len(_CLASSES) - 1)], _OTHER)
    if len(shape):
        shape = shape[np.append(True, shape[1:] != shape[:-1])]  # a run of one kind counts once
    total = np.zeros(BUCKETS)
    code = np.zeros(len(shape), np.uint64)
    for size in range(1, max(SIZES) + 1):
        ahead = shape[size - 1 :]
        code = code[: len(ahead)] * np.uint64(256) + ahead
        if size in SIZES and len(code):
            bucket = mix64(code + np.uint64(size << 40)) >> np.uint64(64 - BUCKET_BITS)
            total += np.bincount(bucket.astype(np.int64), minlength=BUCKETS)
    return total


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of shape n-grams, and some counts of words and lines."""
    text = text or ""
    counts = np.zeros(BUCKETS)
    for at in range(0, len(text), PIECE_CHARS):  # bounds the arrays, not the text
        counts += _shape_counts(text[at : at + PIECE_CHARS])
    words = text.split()
    lines = [line for line in text.split("\n") if line]
    n = max(1, len(words))
    common = sum(c for _, c in Counter(words).most_common(5))
    dense = [
        math.log1p(len(words)) / 10,
        len(set(words)) / n,
        common / n,
        sum(map(len, words)) / n / 10,
        1 - len(set(lines)) / max(1, len(lines)),
        len(lines) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
    ]
    return np.concatenate([np.sqrt(counts / max(1.0, counts.sum())), dense]).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        found = np.array([features(t) @ self.weights for t in texts], np.float64) + self.bias
        return 1 / (1 + np.exp(-np.clip(found, -500, 500)))


def fit_risk(values: np.ndarray, good: np.ndarray, prior: float) -> Model:
    """Minimises the non-negative unbiased risk of the logistic loss, by Adam on batches.

    ``good`` marks the positives among the rows of ``values``, which is not copied.
    """
    dim = values.shape[1]
    positive, unlabelled = np.flatnonzero(good), np.flatnonzero(~good)
    parts = np.array_split(unlabelled, max(1, len(unlabelled) // BATCH))
    mean = sum(values[p].sum(axis=0, dtype=np.float64) for p in parts) / len(unlabelled)
    spread = np.sqrt(sum(((values[p] - mean) ** 2).sum(axis=0) for p in parts) / len(unlabelled)) + 0.02
    mean, spread = mean.astype(np.float32), spread.astype(np.float32)
    weights, bias = np.zeros(dim, np.float32), math.log(prior / (1 - prior))
    first, second = np.zeros(dim + 1), np.zeros(dim + 1)
    order = np.random.default_rng(23)
    rate = RATE / math.sqrt(dim)
    for done in range(1, STEPS + 1):
        picked = (rows if len(rows) <= BATCH else order.choice(rows, BATCH, replace=False) for rows in (positive, unlabelled))
        xp, xu = ((values[rows] - mean) / spread for rows in picked)
        zp, zu = xp @ weights + bias, xu @ weights + bias
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))  # slopes of calling them negative
        at_p, at_u = -prior * gp / len(zp), gu / len(zu)
        if negative >= 0:
            at_p = at_p + prior * (gp - 1) / len(zp)
        else:
            at_p, at_u = -BACK * at_p, -BACK * at_u
        slope = np.append(at_p @ xp + at_u @ xu + DECAY * weights, at_p.sum() + at_u.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = rate * (first / (1 - 0.9**done)) / (np.sqrt(second / (1 - 0.999**done)) + 1e-8)
        weights, bias = (weights - move[:-1]).astype(np.float32), bias - move[-1]
    scaled = weights / spread
    return Model(scaled.astype(np.float32), float(bias - mean @ scaled))


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[["doc_id", "positive"]].assign(values=[features(t).tobytes() for t in batch["text"]])


def _fitted(prior: float):
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["positive", "doc_id"], kind="stable")
        values = np.empty((len(sample), BUCKETS + N_DENSE), np.float32)
        for row, raw in zip(values, sample["values"], strict=True):
            row[:] = np.frombuffer(raw, np.float32)
        good = sample["positive"].to_numpy(bool)
        del sample
        model = fit_risk(values, good, prior)
        del values
        give_back()
        return pd.DataFrame({"at": np.arange(len(model.weights) + 1), "value": np.append(model.weights, model.bias)})

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from rows that are not held out; bounded samples are chosen by a hash of the id.

    Labels in conflict for one id are not trusted. With no positive or no
    unlabelled text, or labels of one value only, every score is the prior.
    """
    trusted = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    trusted = trusted.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    trusted = trusted.where("quality = most").drop("most")
    trusted = cut_lineage(trusted.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "trusted")
    prior = trusted.agg(F.avg("quality")).first()[0]
    prior = 0.5 if prior is None else prior
    flat = Model(np.zeros(BUCKETS + N_DENSE, np.float32), math.log((prior + 1e-3) / (1 - prior + 1e-3)))
    if not 0 < prior < 1:
        return flat
    pick = seeded(F.col("doc_id"), 57)
    good = trusted.where("quality = 1").orderBy(pick, "doc_id").limit(POSITIVES).select("doc_id", F.lit(True).alias("positive"))
    ids = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    free = ids.join(labels.select("doc_id"), "doc_id", "left_anti")
    free = free.orderBy(pick, "doc_id").limit(UNLABELLED).select("doc_id", F.lit(False).alias("positive"))
    picked = cut_lineage(good.unionByName(free), "picked")
    if picked.select("positive").distinct().count() < 2:
        return flat
    # At most POSITIVES + UNLABELLED ids, so the broadcast is bounded.
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    sample = sample.mapInPandas(tidied(_featured), "doc_id long, positive boolean, values binary")
    found = sample.groupBy().applyInPandas(_fitted(float(prior)), "at int, value double").collect()
    values = np.array([r.value for r in sorted(found)])
    return Model(values[:-1].astype(np.float32), float(values[-1]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with held_out, score and predicted; columns of these names are replaced.

    Null and empty texts are scored like any text without words. A null id is not
    held out. Repeated rows pass; an empty table gives an empty result.
    """
    own = docs.drop("held_out", "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = own.withColumn("held_out", held_out(F.col("doc_id")))
    schema = StructType([*out.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = shared.value.score(batch["text"].tolist())
            yield batch.assign(score=score, predicted=(score >= 0.5).astype(np.int32))

    return map_exact(out, run, schema, *long_columns(out))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows predicted to be good, with the columns of ``docs``, whatever their names.

    Null and empty texts are scored like any others, null ids too. An empty table
    stays empty.
    """
    plain, restored = shielded(docs, "doc_id", "text")
    return restored(scored(plain, fit(plain, labels)).where("predicted = 1"))
