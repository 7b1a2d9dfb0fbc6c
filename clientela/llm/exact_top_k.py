"""Exact search for the highest inner products, by branch and bound over vertical blocks.

Candidates lie in blocks of columns: one array for each dimension, those with the most mass first. Scores are
added up for a few dimensions at a time, and after each step only candidates stay whose partial score plus
the most that the remaining dimensions can add (the product of the remaining lengths of query and
candidate) reaches the query's k-th best score so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientela.llm.shared import stored
from clientela.llm.vectors import Chunk, arithmetic, chunks, matrix

# candidates of a vertical block, queries that are looked at together, dimensions of a step
BLOCK, TOGETHER, STEP = 4096, 64, 16
_NONE = np.iinfo(np.int64).min
_SCHEMA = "query_id long, vec_id long, score long"


class Best:
    """The k best (score, id) of each query: higher scores first, then smaller ids."""

    def __init__(self, queries: int, k: int, floors: np.ndarray):
        self.k, self.floors = k, floors
        self.query = np.empty(0, np.int64)
        self.score, self.id = self.query, self.query
        self.kth = np.full(queries, _NONE)

    @property
    def least(self) -> np.ndarray:
        """The least score that can still be among each query's best."""
        return np.maximum(self.kth, self.floors)

    def add(self, query: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        query, score, id = (np.concatenate(p) for p in ((self.query, query), (self.score, score), (self.id, id)))
        order = np.lexsort((id, -score, query))
        query, score, id = query[order], score[order], id[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.score, self.id = query[kept], score[kept], id[kept]
        last = place[kept] == self.k - 1
        self.kth[self.query[last]] = self.score[last]


class Vertical:
    """A block of candidates by dimension, and the length of what remains of each after every step."""

    def __init__(self, rows: np.ndarray, kind: type):
        mass = np.square(rows.astype(np.float64))
        self.order = np.argsort(-mass.sum(axis=0), kind="stable")
        self.columns = np.ascontiguousarray(rows.T[self.order], dtype=kind)
        self.ends = list(range(STEP, rows.shape[1], STEP)) + [rows.shape[1]]
        self.rest = _lengths(mass[:, self.order], self.ends)


def _lengths(mass: np.ndarray, ends: list[int]) -> list[np.ndarray]:
    """Length of each row beyond every one of ``ends``."""
    return [np.sqrt(mass[:, end:].sum(axis=1)) for end in ends]


def _kth_highest(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row, the least there is where there are fewer."""
    if scores.shape[1] <= k:
        return np.full(len(scores), _NONE).astype(scores.dtype)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def search_block(chunk: Chunk, ids: np.ndarray, rows: np.ndarray, best: Best) -> int:
    """Add what a block of candidates has to offer to ``best``; how many scores were added up whole."""
    kind = arithmetic(rows, chunk.rows)
    block, whole = Vertical(rows, kind), 0
    slack = 0 if kind is np.float64 else 4096  # sums of longs lose up to 10 bits as doubles
    for low in range(0, len(chunk.ids), TOGETHER):
        at = np.arange(low, min(low + TOGETHER, len(chunk.ids)))
        queries = chunk.rows[at][:, block.order].astype(kind)
        rest = _lengths(np.square(queries.astype(np.float64)), block.ends)
        least = best.least[at].astype(kind)[:, None]
        live, scores, start = np.arange(len(ids)), np.zeros((len(at), len(ids)), kind), 0
        for step, end in enumerate(block.ends):
            columns = block.columns[start:end] if len(live) == len(ids) else block.columns[start:end, live]
            scores += queries[:, start:end] @ columns
            # rounding must not rule out a candidate that could still reach the bound
            most = np.ceil(rest[step][:, None] * block.rest[step][live] * (1 + 1e-9)) + slack
            kept = (scores + most >= least).any(axis=0)
            if kept.mean() < 0.8:
                live, scores = live[kept], np.ascontiguousarray(scores[:, kept])
            start = end
            if not len(live):
                break
        whole += scores.size
        if not len(live):
            continue
        own = chunk.ids[at][:, None] == ids[live]
        # one of the k + 1 highest is the query's own at most
        bar = np.maximum(least, _kth_highest(scores, best.k + 1)[:, None])
        query, place = np.nonzero((scores >= bar) & ~own)
        best.add(at[query], scores[query, place].astype(np.int64), ids[live][place])
    return whole


def _search(shared, k: int):
    """Best candidates of the rows of a task for every query of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, floors = shared.value
        best = Best(len(chunk.ids), k, floors)
        for batch in batches:
            ids, rows = batch.column("vec_id").to_numpy(), matrix(batch.column("vector"), chunk.width)
            for low in range(0, len(ids), BLOCK):
                search_block(chunk, ids[low : low + BLOCK], rows[low : low + BLOCK], best)
        columns = (chunk.ids[best.query], best.id, best.score)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest inner product with each query.

    ``vectors`` (vec_id, vector) comes from :func:`integer_vectors`; queries are its rows for which
    ``is_query`` holds, candidates all rows but the query's own. Ties go to the smaller id; a query with fewer than
    ``k`` candidates gets all. Shorter vectors count as ending in zeros. No queries or no candidates: no rows.

    Queries go round in chunks of bounded size. The chunk's own rows, searched first, give each query a score that
    its k-th best reaches, so that tasks return few candidates beyond the best.
    """
    spark = vectors.sparkSession
    rounds = []
    for part, chunk in chunks(vectors.filter(is_query), "vec_id"):
        floors = np.full(len(chunk.ids), _NONE)
        first = spark.sparkContext.broadcast((chunk, floors))
        seeds = _merged(part.mapInArrow(_search(first, k), _SCHEMA), k).filter(F.col("rank") == k)
        found = {r.query_id: r.score for r in seeds.collect()}  # at most one row for each query of the chunk
        floors = np.array([found.get(i, _NONE) for i in chunk.ids.tolist()], np.int64)
        shared = spark.sparkContext.broadcast((chunk, floors))
        rounds.append(stored(_merged(vectors.mapInArrow(_search(shared, k), _SCHEMA), k)))
        first.destroy()
        shared.destroy()
    if not rounds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, rounds)
