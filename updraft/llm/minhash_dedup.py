"""Near-duplicates by MinHash with tensored banding.

Two small collections of band values are kept per document. A hash table's key
is a pair, one value from each collection, so ``side * side`` tables cost only
``2 * side`` band values. A pair is only formed from values that some other
document shares: without a shared value in both collections no table can match.

Candidates are checked on full shingle sets in two rounds. The first checks each
document against the best-connected document of the tables they share. The
second looks at what is left: within each table entry, pairs whose ends are not
yet in one component, whose set sizes allow the similarity and whose MinHash
sketches do not rule it out. A shingle that no other document left over has
cannot be in an intersection, so the sizes that count are those of the shared
rest: many variants of one text that are all just too different need no checks.

Such pairs can be as many as the square of a group of variants, so they never
become rows. An entry reports a spanning forest of its open pairs; what hangs
together is a cluster, cut into blocks; each text goes once to each pair of
blocks, where the open pairs are checked in memory, and again a forest of the
links leaves. So a group of n near copies costs about n checks, a group of n that
stay apart n squared checks in blocks, and no link between two components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from updraft.llm.common import cut_lineage, fresh_name, map_exact, mix64, tidied
from updraft.llm.shingles import shingle_sets
from updraft.operators.components import connected_components
from updraft.session import broadcast_if_small

#: Similarity in per cent from which two documents are linked.
PERCENT = 80
WIDTH = 5
#: Band values per collection and MinHash values per band. At similarity 0.8 a
#: pair meets in no table with probability 2 * (1 - 0.8**ROWS)**SIDE = 0.0004.
SIDE, ROWS = 12, 3
#: Hashes of the sketch, one byte of each; the bands use the first of them.
SKETCH = 192
#: Standard deviations by which a sketch may fall short of the similarity.
SLACK = 4.5
#: Members checked against one copy of their head's text.
BLOCK = 256
#: Documents of one table entry, or of one cluster, that are compared in one step,
#: and the shingles that a cluster's block may hold.
ENTRY_BLOCK, CLUSTER_BLOCK, BLOCK_SHINGLES = 512, 1024, 1 << 21

_N_HASHES = SKETCH
_RNG = np.random.default_rng(977)
_MULTIPLY = _RNG.integers(0, 1 << 63, _N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, _N_HASHES, dtype=np.uint64)


def band_values(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The 2 * SIDE band values and the sketch of each non-empty set, one row each."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    everything = np.concatenate(sets)
    least = np.empty((_N_HASHES, len(sets)), np.uint64)
    for k in range(_N_HASHES):
        least[k] = np.minimum.reduceat(everything * _MULTIPLY[k] + _ADD[k], starts)
    bands = np.zeros((2 * SIDE, len(sets)), np.uint64)
    for r in range(ROWS):
        bands = mix64(bands + least[r : 2 * SIDE * ROWS : ROWS] + np.uint64(r + 1))
    sketch = (mix64(least) & np.uint64(255)).astype(np.uint8)
    return (bands.T >> np.uint64(32)).astype(np.uint32), np.ascontiguousarray(sketch.T)


def _signatures(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            sketches: list = [None] * len(sets)
            for at in range(0, len(full), 64):
                part = full[at : at + 64]
                for i, band, sketch in zip(part, *band_values([sets[i] for i in part]), strict=True):
                    bands[i], sketches[i] = band.view(np.int32), sketch.tobytes()
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "text_key": batch["text_key"],
                "n_shingles": [len(s) for s in sets],
                "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "bands": bands,
                "sketch": sketches,
            })

    return run


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, digests of the text and of the whole set, n_shingles, the band values and the sketch."""
    schema = "doc_id long, text_key string, n_shingles long, set_key binary, bands array<int>, sketch binary"
    return map_exact(keyed(docs), _signatures(width), schema, "doc_id")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.col("text").cast("binary")).alias("text_key"))


def _check(width: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head_id, head_set = None, np.zeros(0, np.uint64)
        for batch in batches:
            linked = []
            for head, doc, values in zip(batch["head"], batch["doc"], shingle_sets(batch["text"].tolist(), width), strict=True):
                if head == doc:  # sorted before its members
                    head_id, head_set = head, values
                    continue
                if head != head_id:
                    raise ValueError(f"text of head {head} is missing")
                both = len(np.intersect1d(values, head_set, assume_unique=True))
                if 100 * both >= percent * (len(values) + len(head_set) - both):
                    linked.append((head, doc))
            yield pd.DataFrame(linked, columns=["u", "v"]).astype("int64")

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (head, doc) whose full sets reach the similarity, as (u, v).

    A head's text travels once per block of members; a head with many members
    has many blocks. ``pairs`` must be stored, ``texts`` has one row per doc.
    """
    per_head = cut_lineage(pairs.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "heads")
    # Only heads with several blocks need a number, one for BLOCK rows at most: a hot head's rows stay where they are.
    several = pairs.join(broadcast_if_small(per_head.where("blocks > 1")), "head", "left")
    block = F.pmod(F.xxhash64("doc"), F.coalesce("blocks", F.lit(1).cast("long"))).alias("block")
    members = several.select("head", block, "doc")
    heads = per_head.select("head", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("head").alias("doc"))
    rows = members.unionByName(heads).join(texts, "doc")
    # The head sorts before the members of its block.
    dealt = rows.repartition("head", "block").withColumn("member", F.col("doc") != F.col("head"))
    ordered = dealt.sortWithinPartitions("head", "block", "member").select("head", "doc", "text")
    return ordered.mapInPandas(tidied(_check(width, percent)), "u long, v long")


def near_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Texts with equal sets collapse to one class first. A text without words, or
    null, and a row with a null id link with nothing. Rows that share an id are
    one document, whatever their texts: what is near to one of them is in its
    component. An empty table gives an empty result; other columns are ignored.
    """
    signed = cut_lineage(signatures(docs, width), "signed")
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets have equal signatures, so any row of a class stands for it.
    first = [F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")]
    classes = usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), *first)
    # Written before it is used, so the numbers stay what they are.
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    entries = cut_lineage(shared_entries(classes), "entries")
    # One text of each class that may be checked. Both sides can be large: no broadcast.
    wanted = classes.select("node", "row.doc_id", "row.text_key").join(entries.select("node").distinct(), "node", "left_semi")
    texts = keyed(docs).join(wanted.hint("merge"), ["doc_id", "text_key"]).select(F.col("node").alias("doc"), "text")
    texts = cut_lineage(texts.dropDuplicates(["doc"]), "texts")

    links = confirmed(_stars(entries), texts, width, percent).unionByName(_same_id(usable, classes))
    links = cut_lineage(links, "links")
    known = connected_components(links)
    more = cut_lineage(_settled(_facing(entries, known, classes, texts, width, percent), texts, width, percent), "links")
    if not more.isEmpty():
        known = connected_components(links.unionByName(more))
    placed = classes.select("set_key", "node", "row.doc_id").join(known, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("_component"))
    by_class = placed.select("set_key", "component").join(least, "component").select("set_key", "_component")
    found = signed.join(by_class, "set_key", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_component")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def _same_id(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v) between the classes of an id that has several sets."""
    sets = usable.groupBy("doc_id").agg(F.min("set_key").alias("u"), F.max("set_key").alias("v")).where("u <> v")
    others = usable.select("doc_id", "set_key").join(sets, "doc_id").where("set_key <> u").select("u", F.col("set_key").alias("v")).distinct()
    nodes = [classes.select(F.col("set_key").alias(c), F.col("node").alias(f"{c}_node")) for c in ("u", "v")]
    return others.join(nodes[0], "u").join(nodes[1], "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))


def shared_entries(classes: DataFrame) -> DataFrame:
    """(key, node, weight): the table entries that two classes or more share.

    ``weight`` is a node's number of neighbours, counted over all its entries.
    """
    halves = classes.select("node", F.posexplode("bands").alias("band", "value"))
    shared = halves.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    live = halves.join(shared, ["band", "value"], "left_semi")
    # At most 2 * SIDE values meet in one row.
    value = F.struct("band", "value")
    sides = live.groupBy("node").agg(
        F.collect_list(F.when(F.col("band") < SIDE, value)).alias("left"),
        F.collect_list(F.when(F.col("band") >= SIDE, value)).alias("right"),
    )
    crossed = sides.select("node", F.explode("left").alias("l"), "right").select("node", "l", F.explode("right").alias("r"))
    code = F.col("l.band") * SIDE + F.col("r.band") - SIDE
    keys = crossed.select(F.xxhash64("l.band", "l.value", "r.band", "r.value").alias("key"), code.alias("tab"), "node")
    keys = cut_lineage(keys, "keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    entries = keys.join(sizes, "key")
    weights = entries.groupBy("node").agg(F.sum(F.col("size") - 1).alias("weight"))
    return entries.join(weights, "node").select("key", "tab", "node", "size", "weight")


def _stars(entries: DataFrame) -> DataFrame:
    """Each node with the head it shares most entries with; an entry's head has most neighbours."""
    heads = entries.groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("head"))
    votes = entries.join(heads, "key").where("node <> head").groupBy("node", "head").agg(F.count("*").alias("tables"))
    best = votes.groupBy("node").agg(F.max_by("head", F.struct("tables", -F.col("head"))).alias("head"))
    return cut_lineage(best.select("head", F.col("node").alias("doc")), "stars")


def _least_match(percent: int) -> float:
    """Share of equal sketch values below which the similarity is ruled out."""
    return percent / 100 - SLACK * np.sqrt(percent / 100 * (1 - percent / 100) / SKETCH)


def _open_pairs(group: pd.DataFrame, percent: int, tab: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows between the group's two blocks that share a table and that nothing rules out.

    With ``tab`` only the pairs whose first shared table it is, so that a pair is open in one table entry.
    """
    lo, hi = int(group["lo"].iloc[0]), int(group["hi"].iloc[0])
    side, part, n, shared = (group[c].to_numpy() for c in ("block", "part", "n_shingles", "shared"))
    bands = np.array(group["bands"].tolist(), np.int32)
    sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), SKETCH)
    left, b = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
    for at in range(0, len(left), 256):
        a = left[at : at + 256]
        most = np.minimum(shared[a][:, None], shared[b])  # of the intersection
        fits = (part[a][:, None] != part[b]) & (100 * most >= percent * (n[a][:, None] + n[b] - most))
        if lo == hi:
            fits &= a[:, None] < b
        x, y = np.nonzero(fits)
        x, y = a[x], b[y]
        for k in range(0, len(x), 1 << 14):
            i, j = x[k : k + (1 << 14)], y[k : k + (1 << 14)]
            same = bands[i] == bands[j]
            met = same[:, :SIDE].any(axis=1) & same[:, SIDE:].any(axis=1)
            if tab is not None:
                met &= same[:, :SIDE].argmax(axis=1) * SIDE + same[:, SIDE:].argmax(axis=1) == tab
            i, j = i[met], j[met]
            keep = (sketch[i] == sketch[j]).mean(axis=1) >= _least_match(percent)
            yield i[keep], j[keep]


class _Forest:
    """Edges that first join two trees, among all nodes that a task meets."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, i: int) -> int:
        parent = self.parent
        while (up := parent.get(i, i)) != i:
            parent[i] = i = parent.get(up, up)
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.parent[b] = a
        return a != b


def _by_group(keys: list[str], edges: Callable[[pd.DataFrame, _Forest], list[tuple[int, int]]]):
    """``edges`` of each group of rows that are sorted by ``keys``; a task's groups share a forest."""

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the last group of a batch may go on in the next one
        forest = _Forest()

        def run(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(edges(group, forest), columns=["u", "v"]).astype("int64")

        for batch in batches:
            if not len(batch):
                continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            values = rows[keys].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1])
            found = [run(rows.iloc[i:j]) for i, j in zip(starts[:-1], starts[1:], strict=True)]
            rest = rows.iloc[starts[-1] :]
            if found:
                yield pd.concat(found, ignore_index=True)
        if rest is not None:
            yield run(rest)

    return groups


def _compared(percent: int):
    """A spanning forest of the open pairs of a table entry's two blocks."""

    def edges(group: pd.DataFrame, forest: _Forest) -> list[tuple[int, int]]:
        node, tab = group["node"].to_numpy(), int(group["tab"].iloc[0])
        pairs = ((u, v) for x, y in _open_pairs(group, percent, tab) for u, v in zip(node[x].tolist(), node[y].tolist(), strict=True))
        return [(u, v) for u, v in pairs if forest.join(u, v)]

    return _by_group(["key", "lo", "hi"], edges)


def _verified(width: int, percent: int):
    """A spanning forest of the links between a cluster's two blocks, found on whole sets."""

    def edges(group: pd.DataFrame, forest: _Forest) -> list[tuple[int, int]]:
        node, found = group["node"].tolist(), []
        sets = shingle_sets(group["text"].tolist(), width)
        for x, y in _open_pairs(group, percent):
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                if forest.root(node[i]) == forest.root(node[j]):
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    forest.join(node[i], node[j])
                    found.append((node[i], node[j]))
        return found

    return _by_group(["cluster", "lo", "hi"], edges)


def _shingle_rows(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), width)
            yield pd.DataFrame({
                "node": np.repeat(batch["doc"].to_numpy(), [len(s) for s in sets]),
                "shingle": np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64),
            })

    return run


def shared_sizes(texts: DataFrame, width: int) -> DataFrame:
    """(node, lonely): how many shingles of each text no other one has; texts without any are left out."""
    rows = texts.select("doc", "text").mapInPandas(tidied(_shingle_rows(width)), "node long, shingle long")
    alone = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    return alone.groupBy("node").agg(F.count("*").alias("lonely"))


#: What tells whether a pair is open.
_ABOUT = ("part", "n_shingles", "shared", "bands", "sketch")


def _in_block_pairs(rows: DataFrame) -> DataFrame:
    """Every row once for each pair of blocks that its own block is in; ``rows`` have node and blocks."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    return numbered.select("*", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))


def _facing(
    entries: DataFrame, known: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int
) -> tuple[DataFrame, DataFrame]:
    """A forest (u, v) of the open pairs, whose ends are in different components, and what tells them."""
    placed = entries.join(known, "node", "left").withColumn("part", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("size"))
    mixed = mixed.where("least < most").select("key", F.ceil(F.col("size") / ENTRY_BLOCK).alias("blocks"))
    members = cut_lineage(placed.select("key", "tab", "node", "part").join(mixed, "key"), "members")
    left = members.select(F.col("node").alias("doc")).distinct()
    lonely = shared_sizes(texts.join(left.hint("merge"), "doc", "left_semi"), width)
    shared = (F.col("n_shingles") - F.coalesce("lonely", F.lit(0))).alias("shared")
    about = classes.join(lonely, "node", "left").select("node", "n_shingles", shared, "bands", "sketch")
    # Not even a subset of such a document could be similar enough.
    about = about.where(F.col("shared") * 100 >= F.col("n_shingles") * percent)
    about = cut_lineage(about.join(members.select("node", "part").distinct(), "node"), "about")
    full = _in_block_pairs(members.drop("part")).join(about, "node")
    ordered = full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    ordered = ordered.select("key", "lo", "hi", "tab", "block", "node", *_ABOUT)
    return cut_lineage(ordered.mapInPandas(tidied(_compared(percent)), "u long, v long"), "pairs"), about


def _settled(facing: tuple[DataFrame, DataFrame], texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Forest (u, v) of the links among open pairs; a text goes once to each pair of blocks of its cluster."""
    forest, about = facing
    clusters = connected_components(forest).withColumnRenamed("component", "cluster")
    # The smallest node of a cluster is not among the nodes that hang on it.
    clusters = cut_lineage(clusters.unionByName(clusters.select(F.col("cluster").alias("node"), "cluster")).distinct(), "clusters")
    placed = clusters.join(about, "node")
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    blocks = F.ceil(F.greatest(F.col("n") / CLUSTER_BLOCK, F.col("s") / BLOCK_SHINGLES)).alias("blocks")
    dealt = _in_block_pairs(clusters.join(sizes.select("cluster", blocks), "cluster"))
    full = dealt.join(about, "node").join(texts.withColumnRenamed("doc", "node"), "node")
    ordered = full.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "node")
    ordered = ordered.select("cluster", "lo", "hi", "block", "node", *_ABOUT, "text")
    return ordered.mapInPandas(tidied(_verified(width, percent)), "u long, v long")


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows whose document stays, with the columns of ``docs``, whatever their names.

    All rows of an id stay or go together; rows with a null id stay. An empty
    table stays empty.
    """
    own = fresh_name("kept_id", docs.columns)
    found = near_components(docs, width, percent).where("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left_semi")
