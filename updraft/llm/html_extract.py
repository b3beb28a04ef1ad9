"""Main text of pages by a tree-structured graphical model.

Every block element and every text run of a page is a node with a hidden state:
frame (holds several regions), content, or other. A potential couples each node
with its parent, another one each state with what is seen of the node: names,
text length, share of links, form controls. One sum-product pass up the tree and
one down give the exact marginal of each text run; runs whose content marginal
is the larger one make up the text. The potentials are relative frequencies,
counted by Spark over labelled pages.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.llm import html_pages
from updraft.llm.common import map_exact
from updraft.llm.html_tree import Tree, parse

FRAME, CONTENT, OTHER = range(3)
#: Labelled pages that the model is counted on.
TRAINING_PAGES = 3000
#: Added to every count.
SMOOTHING = 0.5


def _step(value: float, limits: tuple) -> int:
    return sum(value >= limit for limit in limits)


def _size(chars: int) -> int:
    return _step(chars, (1, 25, 80, 200, 600, 2000))


def _share(linked: int, chars: int) -> int:
    return _step(linked / max(chars, 1), (0.01, 0.25, 0.5, 0.8))


def observations(tree: Tree) -> list[list[str]]:
    """What is seen of each node: the elements in page order, then the runs."""
    n = len(tree.tags)
    chars, linked, controls = [0] * n, [0] * n, list(tree.controls)
    for element, text, inside in tree.runs:
        chars[element] += len(text)
        linked[element] += inside
    for i in range(n - 1, 0, -1):
        up = tree.parents[i]
        chars[up] += chars[i]
        linked[up] += linked[i]
        controls[up] += controls[i]
    seen = []
    inner = set(tree.parents)
    for i in range(n):
        up = tree.tags[tree.parents[i]] if i else ""
        names = [f"tag={tree.tags[i]}", f"under={tree.tags[i]}<{up}", *[f"name={w}" for w in tree.words[i]]]
        if i in inner:  # of a leaf, its own runs tell
            names += [f"below={_size(chars[i])},{_share(linked[i], chars[i])}", f"controls={min(controls[i], 1)}"]
        seen.append(names)
    for element, text, inside in tree.runs:
        ends = text[-1] in ".!?:;\"'”»…"
        seen.append([f"in={tree.tags[element]}", f"run={_size(len(text))},{_share(inside, len(text))},{int(ends)}", f"sign={int('©' in text)}"])
    return seen


@dataclass
class Model:
    """Log potentials: ``step[parent][child]`` and per observation one for each state."""

    step: np.ndarray
    seen: dict[str, np.ndarray]

    def content(self, tree: Tree) -> list[float]:
        """The marginal of the content state for each run."""
        n = len(tree.tags)
        parents = tree.parents + [r[0] for r in tree.runs]
        own = np.zeros((len(parents), 3))
        for i, names in enumerate(observations(tree)):
            for name in names:
                if (weight := self.seen.get(name)) is not None:
                    own[i] += weight
        own[n:, FRAME] = -1e3  # a run is either content or not
        own = np.exp(np.maximum(own - own.max(axis=1, keepdims=True), -600)).tolist()
        step = np.exp(self.step).tolist()
        states = range(3)
        # Upward: what the nodes below say about each node's parent.
        up: list = [None] * len(parents)
        children: dict[int, list[int]] = defaultdict(list)
        order = [*range(len(parents) - 1, n - 1, -1), *range(n - 1, 0, -1)]
        for i in order:
            message = [sum(step[p][c] * own[i][c] for c in states) for p in states]
            total = sum(message)
            up[i] = message = [m / total for m in message]
            about = own[parents[i]]
            about = [a * m for a, m in zip(about, message, strict=True)]
            total = sum(about) or 1e-300
            own[parents[i]] = [max(a / total, 1e-200) for a in about]
            children[parents[i]].append(i)
        # Downward: own now holds the beliefs from below; each node hears from its parent.
        belief = own
        for i in reversed(order):
            rest = [b / m for b, m in zip(belief[parents[i]], up[i], strict=True)]
            total = sum(rest)
            heard = [sum(rest[p] / total * step[p][c] for p in states) for c in states]
            mine = [b * h for b, h in zip(belief[i], heard, strict=True)]
            total = sum(mine) or 1e-300
            belief[i] = [max(m / total, 1e-200) for m in mine]
        return [belief[n + k][CONTENT] for k in range(len(tree.runs))]

    def extract(self, source: str | None) -> str:
        tree = parse(source or "")
        return " ".join(text for (_, text, _), p in zip(tree.runs, self.content(tree), strict=True) if p >= 0.5)


def labelled_counts(source: str) -> Iterator[tuple[str, int]]:
    """(name, state) for everything that a labelled page shows."""
    tree = parse(source, html_pages.MARK)
    states = []
    for i, mark in enumerate(tree.marks):
        inherited = states[tree.parents[i]] if i else FRAME
        states.append({"c": CONTENT, "o": OTHER}.get(mark, inherited))
    # A run outside of all regions is no content.
    states += [states[e] or OTHER for e, _, _ in tree.runs]
    parents = tree.parents + [e for e, _, _ in tree.runs]
    for i, names in enumerate(observations(tree)):
        if parents[i] >= 0:
            yield f"step={states[parents[i]]}", states[i]
        for name in names:
            yield name, states[i]


def _count_pages(seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[str, int], int] = defaultdict(int)
        for batch in batches:
            for number in batch["id"]:
                for key in labelled_counts(html_pages.Maker(seed * 1_000_003 + int(number)).page()):
                    counts[key] += 1
        yield pd.DataFrame([(name, state, n) for (name, state), n in counts.items()], columns=["name", "state", "n"])

    return run


def fit(spark: SparkSession, pages: int = TRAINING_PAGES, seed: int = 7) -> Model:
    """The potentials from ``pages`` labelled pages; the table of counts has some hundred rows."""
    made = spark.range(pages).repartition(8).mapInPandas(_count_pages(seed), "name string, state int, n long")
    rows = made.groupBy("name", "state").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.full(3, SMOOTHING))
    for name, state, n in rows:
        counts[name][state] += n
    step = np.array([counts.pop(f"step={s}") for s in range(3)])
    seen = {}
    totals = {kind: sum(v for k, v in counts.items() if k.split("=")[0] in kind.split()) for kind in ("tag", "in")}
    for name, n in counts.items():
        # A state's frequency of the observation among all its nodes of that kind.
        seen[name] = np.log(n / totals["in" if name.split("=")[0] in ("in", "run", "sign") else "tag"])
    return Model(np.log(step / step.sum(axis=1, keepdims=True)), seen)


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text, as does a page without content. Null
    ids and repeated rows pass like any others; other columns are ignored; an
    empty table gives an empty result.
    """
    model = model or fit(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [model.extract(source) for source in batch["html"]]
            yield batch[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])

    schema = "page_id long, url string, text string, n_chars long"
    return map_exact(pages.select(F.col("page_id").cast("long"), "url", "html"), run, schema, "page_id")
