"""Hard negatives from an R-tree packed by sort-tile-recursion.

Vectors are dealt to tasks by label and leading coordinate, and each task packs its rows: sorted along one coordinate,
cut into slabs, each slab sorted along the next, down to leaves of one label. A node's least and greatest
value of each coordinate bound the inner product of an anchor with all that lies below it. A queue takes the
node of highest bound first, and leaves out nodes outside every score window or strictly below the k-th best.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientela.llm.shared import stored
from clientela.llm.vectors import Chunk, arithmetic, axes_by_variance, chunks, matrix

LEAF_ROWS, FANOUT = 256, 8
# coordinates along which tiles are cut, those of greatest variance first
TILED = 6
# entries of the matrix of bounds of a tree's nodes for the anchors looked at together
_BOUNDS = 1 << 21


def tiles(rows: np.ndarray, order: list[int], leaf: int) -> list[np.ndarray]:
    """Sort-tile-recursive packing: row numbers of each leaf, neighbours next to each other."""

    def cut(at: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        leaves = -(-len(at) // leaf)
        if leaves <= 1 or depth == len(order):
            yield from (at[i : i + leaf] for i in range(0, len(at), leaf))
            return
        slabs = int(np.ceil(leaves ** (1 / (len(order) - depth)) - 1e-9))
        size = leaf * -(-leaves // slabs)
        at = at[np.argsort(rows[at, order[depth]], kind="stable")]
        for i in range(0, len(at), size):
            yield from cut(at[i : i + size], depth + 1)

    return list(cut(np.arange(len(rows)), 0))


def _packed(order: list[int], leaf: int):
    """Rows in the order of their leaves, with the leaf's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            labels, rows = batch.column("label").to_numpy(), matrix(batch.column("vector"))
            axes = [a for a in order if a < rows.shape[1]]
            taken, leaves = [], []
            for label in np.unique(labels):
                own = np.flatnonzero(labels == label)
                for part in tiles(rows[own], axes, leaf):
                    taken.append(own[part])
                    leaves.append(np.full(len(part), number))
                    number += 1
            if taken:
                out = batch.take(pa.array(np.concatenate(taken)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(leaves), pa.int64())], names=["vec_id", "label", "vector", "leaf"])

    return run


def packed(vectors: DataFrame, leaf: int = LEAF_ROWS) -> DataFrame:
    """``vectors`` (vec_id, label, vector) as a table of leaves (column ``leaf``) in packing order.

    Rows meet by ranges of (label, leading coordinate, id), so a label, a value or a vector that very many rows share
    is spread over tasks.
    """
    order = axes_by_variance(vectors)[:TILED]
    lead = [F.try_element_at("vector", F.lit(order[0] + 1))] if order else []
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = vectors.select("vec_id", "label", "vector").repartitionByRange(partitions, "label", *lead, "vec_id")
    schema = ", ".join(f"{n} {t}" for n, t in dealt.dtypes) + ", leaf long"
    return stored(dealt.mapInArrow(_packed(order, leaf), schema))


class Tree:
    """Leaves in packing order and the levels above them: boxes, least ids and labels of each node."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, leaf: np.ndarray, rows: np.ndarray, kind: type):
        self.ids, self.rows = ids, rows.astype(kind)
        begins = np.flatnonzero(np.concatenate(([True], (leaf[1:] != leaf[:-1]) | (labels[1:] != labels[:-1]))))
        self.begins, self.ends = begins.tolist(), [*begins[1:].tolist(), len(ids)]
        low, high = np.minimum.reduceat(self.rows, begins), np.maximum.reduceat(self.rows, begins)
        least, first, last = np.minimum.reduceat(ids, begins), labels[begins], labels[begins]
        self.children: list[range | None] = [None] * len(begins)
        parts, start = [(low, high, least, first, last)], 0
        while len(low) > FANOUT:
            cuts = np.arange(0, len(low), FANOUT)
            self.children += [range(start + c, start + min(c + FANOUT, len(low))) for c in cuts]
            start += len(low)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            least, first, last = np.minimum.reduceat(least, cuts), np.minimum.reduceat(first, cuts), np.maximum.reduceat(last, cuts)
            parts.append((low, high, least, first, last))
        self.low, self.high, least, first, last = (np.concatenate(p) for p in zip(*parts))
        self.least, self.first, self.last = least.tolist(), first.tolist(), last.tolist()
        self.roots = range(start, start + len(low))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each query with anything in each node's box."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


class Query:
    """An anchor's windows of scores, and the k best (-score, id) found in each."""

    def __init__(self, id: int, label: int, lows: list[int], highs: list[int], k: int, same: bool):
        self.id, self.label, self.k, self.same = id, label, k, same
        self.lows, self.highs = lows, highs
        self.best: list[list[tuple[int, int]]] = [[] for _ in lows]

    def bar(self, window: int) -> int:
        """The least score that can still be among the window's best."""
        best = self.best[window]
        return max(self.lows[window], -best[-1][0]) if len(best) == self.k else self.lows[window]

    def wants(self, low: float, high: float, least_id: int, first: int, last: int) -> bool:
        """Whether a node with these bounds, least id and labels can hold something."""
        if (not first <= self.label <= last) if self.same else (first == last == self.label):
            return False
        for window, top in enumerate(self.highs):
            if low <= top and high >= self.bar(window):
                best = self.best[window]
                if len(best) < self.k or (-min(high, top), least_id) < best[-1]:
                    return True
        return False

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        bars = [self.bar(w) for w in range(len(self.lows))]
        near = np.flatnonzero((scores >= min(bars)) & (scores <= max(self.highs)))
        if not len(near):
            return
        near_scores, near_ids = scores[near], ids[near]
        for window, (bar, top) in enumerate(zip(bars, self.highs)):
            inside = np.flatnonzero((near_scores >= bar) & (near_scores <= top))
            if len(inside) > self.k:
                inside = inside[np.lexsort((near_ids[inside], -near_scores[inside]))[: self.k + 1]]
            found = [(-int(s), int(i)) for s, i in zip(near_scores[inside], near_ids[inside]) if i != self.id]
            if found:
                self.best[window] = sorted([*self.best[window], *found])[: self.k]


def best_first(tree: Tree, vector: np.ndarray, low: list[float], high: list[float], query: Query) -> int:
    """Search a tree for a query, nodes of highest bound first; how many leaves were looked at."""
    top, looked = max(query.highs), 0

    def wanted(node: int) -> bool:
        return query.wants(low[node], high[node], tree.least[node], tree.first[node], tree.last[node])

    queue = [(-min(high[n], top), n) for n in tree.roots if wanted(n)]
    heapq.heapify(queue)
    while queue:
        _, node = heapq.heappop(queue)
        if not wanted(node):  # better ones were found since it was put in
            continue
        if tree.children[node] is None:
            a, b = tree.begins[node], tree.ends[node]
            query.take(tree.rows[a:b] @ vector, tree.ids[a:b])
            looked += 1
        else:
            for child in tree.children[node]:
                if wanted(child):
                    heapq.heappush(queue, (-min(high[child], top), child))
    return looked


def _searched(shared, k: int, same: bool):
    """The k best rows of a task for each window of each anchor of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, lows, highs = shared.value
        labels = chunk.columns["label"].tolist()
        queries = [
            Query(i, label, [x for x, y in zip(a, b) if x <= y], [y for x, y in zip(a, b) if x <= y], k, same)
            for i, label, a, b in zip(chunk.ids.tolist(), labels, lows.tolist(), highs.tolist())
        ]
        windows = [[w for w, (x, y) in enumerate(zip(a, b)) if x <= y] for a, b in zip(lows.tolist(), highs.tolist())]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column("vector"), chunk.width)
            kind = arithmetic(rows, chunk.rows)
            tree = Tree(*(batch.column(c).to_numpy() for c in ("vec_id", "label", "leaf")), rows, kind)
            together = max(1, _BOUNDS // len(tree.low))
            for start in range(0, len(queries), together):
                vectors = chunk.rows[start : start + together].astype(kind)
                low, high = tree.bounds(vectors)
                for i, query in enumerate(queries[start : start + together]):
                    if query.lows:
                        best_first(tree, vectors[i], low[i].tolist(), high[i].tolist(), query)
        found = [(q.id, w, i, -s) for q, at in zip(queries, windows) for w, best in zip(at, q.best) for s, i in best]
        columns = list(zip(*found)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "window", "vec_id", "score"])

    return run


def _search(leaves: DataFrame, chunk: Chunk, lows: np.ndarray, highs: np.ndarray, k: int, same: bool) -> DataFrame:
    """(anchor_id, window, vec_id, score, rank): the best rows of each window over all tasks, as a table."""
    shared = leaves.sparkSession.sparkContext.broadcast((chunk, lows, highs))
    found = leaves.mapInArrow(_searched(shared, k, same), "anchor_id long, window long, vec_id long, score long")
    place = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    out = stored(found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k))
    shared.destroy()
    return out


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, leaf: int = LEAF_ROWS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` (vec_id, label, vector) comes from :func:`integer_vectors`. An anchor's positives are the ``positives``
    other rows of its label with the highest inner product; for each, the ``negatives`` rows of another label of highest
    score between ``low`` and ``high`` percent of the positive's. Ties go to smaller ids; where there are fewer, all
    are returned. A positive with a negative score has an empty window. Shorter vectors count as ending in zeros.
    No anchors, an anchor alone with its label, or no other label: no rows.
    """
    spark = vectors.sparkSession
    leaves, rounds = packed(vectors, leaf), []
    for _, chunk in chunks(vectors.filter(is_anchor).select("vec_id", "label", "vector"), "vec_id"):
        n = len(chunk.ids)
        whole = np.iinfo(np.int64)
        near = _search(leaves, chunk, np.full((n, 1), whole.min), np.full((n, 1), whole.max), positives, same=True)
        # at most `positives` rows for each anchor of the chunk come back
        place = {id: i for i, id in enumerate(chunk.ids.tolist())}
        lows, highs = np.ones((n, positives), np.int64), np.zeros((n, positives), np.int64)  # empty windows
        for r in near.select("anchor_id", "rank", "score").collect():
            at = place[r["anchor_id"]], r["rank"] - 1
            lows[at], highs[at] = -(-low * r["score"] // 100), high * r["score"] // 100
        found = _search(leaves, chunk, lows, highs, negatives, same=False)
        pairs = near.select("anchor_id", (F.col("rank") - 1).cast("long").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        rounds.append(
            found.join(pairs, ["anchor_id", "window"]).select(
                "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
            )
        )
    if not rounds:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, rounds)
