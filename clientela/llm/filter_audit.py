"""How filters interact: what each removes in every order of applying them.

A document is known by the set of filters that it fails. Under an order it goes at the first filter of its
set, so the orders under which it goes at one step share a prefix: some filters outside the set, then one
of it. In lexicographic order (by Lehmer rank) the permutations of a prefix are one interval. Each set's
count is added at the start of its intervals and taken off at their ends; running sums over the ranks then
give every step of every order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clientela.llm.shared import slices, stored
from clientela.llm.words import Words, texts_of

_FEATURES = "doc_id long, part string, fails int, head long, tail long"
_MARKED = np.zeros(256, bool)
_MARKED[np.frombuffer(b"#$%&*|", np.uint8)] = True


def _judge(least_words: int, least_distinct: int, most_capitals: int):
    """Failed conditions as bits (A is 1) and a digest of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = texts_of(part.column("text"))
            words = Words(texts)
            hashes, counts = words.hashes(fold_case=False), words.counts()
            distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(words.first[:-1], words.first[1:])], np.int64)

            def in_text(found: np.ndarray) -> np.ndarray:
                sums = np.concatenate(([0], np.cumsum(found, dtype=np.int64)))
                return sums[words.begins[1:]] - sums[words.begins[:-1]]

            data = words.data
            points = in_text((data & 0xC0) != 0x80) - 1  # less the line feed behind each text
            capitals = in_text((data >= 65) & (data <= 90))
            tests = [counts < least_words, 100 * distinct < least_distinct * counts, 100 * capitals > most_capitals * points, in_text(_MARKED[data]) > 0]
            fails = sum(test.astype(np.int32) << i for i, test in enumerate(tests))
            digests = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts), "<i8").reshape(-1, 2)
            columns = [part.column("doc_id"), part.column("part"), *(pa.array(c) for c in (fails.astype(np.int32), digests[:, 0], digests[:, 1]))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "fails", "head", "tail"])

    return run


def failures(documents: DataFrame, part: Column, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 2) -> DataFrame:
    """(doc_id, part, fails, n): which of five filters the documents fail, as bits (A is 1, E is 16).

    A: under ``least_words`` words; B: under ``least_distinct`` percent of them distinct; C: over ``most_capitals`` percent of
    the characters are A-Z; D: holds one of ``#$%&*|``; E: the text is that of a smaller doc_id. Null texts are empty, a null
    ``part`` is an empty string, rows without doc_id are left out. Each row counts (``n`` where rows agree), and rows of
    one id are no copies of each other. Texts are compared by 128-bit digests.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    judged = stored(docs.filter("doc_id IS NOT NULL").mapInArrow(_judge(least_words, least_distinct, most_capitals), _FEATURES))
    # copies are reduced where they are, to one row a text and task, before they meet
    first = judged.groupBy("head", "tail").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    rows = judged.groupBy("doc_id", "head", "tail", "part", "fails").agg(F.count("*").alias("n"))
    copy = F.when(F.col("is_first"), 0).otherwise(16)
    return rows.join(first, ["doc_id", "head", "tail"], "left").select("doc_id", "part", F.col("fails").bitwiseOR(copy).alias("fails"), "n")


def orders(letters: str) -> list[tuple[int, str]]:
    """Every order of the filters with its Lehmer rank: its place if filters sort as in ``letters``."""
    return [(rank, "".join(p)) for rank, p in enumerate(permutations(letters))]


def intervals(letters: str) -> list[tuple[int, int, int, int]]:
    """(fails, step, low, high): documents of that set go at that step in the orders of ranks low to high - 1.

    For five filters 840 rows; their number depends on the number of filters alone.
    """
    size, out = len(letters), []

    def extend(used: int, step: int, low: int) -> None:
        """Filters of ``used`` came first, in the orders from ``low`` on."""
        width = factorial(size - step)
        for i in range(size):
            if used >> i & 1:
                continue
            # fails this filter and none of those before: any set of the others beside it
            others = [j for j in range(size) if j != i and not used >> j & 1]
            for chosen in range(1 << len(others)):
                fails = 1 << i | sum(1 << j for k, j in enumerate(others) if chosen >> k & 1)
                out.append((fails, step, low, low + width))
            if step < size:
                extend(used | 1 << i, step + 1, low)
            low += width

    extend(0, 1, 0)
    return out


def _fixed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table whose size the number of filters fixes."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def interactions(failed: DataFrame, letters: str = "ABCDE", weights: tuple[str, ...] = ()) -> DataFrame:
    """What every filter removes at every step of every order, for each part.

    ``failed`` (part, fails, n, *weights): ``n`` documents of a part that fail the filters of ``fails`` (bit i: letter i); rows
    may repeat; ``weights`` are flags that they have. Result: part, filter_order, step, kept after the step, removed by it,
    redundant (fail its filter but went before), unique_fails (fail its filter alone), <flag>_lost for each flag, and shapley
    (removed by its filter, summed over all orders). One row for each part, order and step, zeros included; an empty
    table gives none. A part is at most one row a set of filters before its orders are looked at.
    """
    if not 1 <= len(letters) <= 8:
        raise ValueError("one to eight filters: there are n! orders")
    spark, size = failed.sparkSession, len(letters)
    sums = ["n", *(f"n_{w}" for w in weights)]
    counted = failed.select("part", "fails", "n", *(F.when(F.col(w), F.col("n")).otherwise(0).alias(f"n_{w}") for w in weights))
    counted = stored(counted.groupBy("part", "fails").agg(*(F.sum(s).alias(s) for s in sums)))

    at = _fixed(spark, intervals(letters), "fails int, step int, low int, high int")
    spans = counted.join(at, "fails")
    ends = F.array(*(F.struct(F.col(edge).alias("rank"), *((F.col(s) * sign).alias(s) for s in sums)) for edge, sign in (("low", 1), ("high", -1))))
    edges = spans.select("part", "step", F.inline(ends).alias("rank", *sums)).filter(F.col("rank") < factorial(size))
    of_part = counted.groupBy("part").agg(F.sum("n").alias("documents"))
    ranks = _fixed(spark, [(rank, order, step, order[step - 1]) for rank, order in orders(letters) for step in range(1, size + 1)], "rank int, filter_order string, step int, letter string")
    bits = F.array(*(F.struct(F.lit(c).alias("letter"), F.lit(1 << i).alias("bit")) for i, c in enumerate(letters)))
    hits = F.col("fails").bitwiseAND(F.col("bit")) != 0
    of_filter = (
        counted.select("part", "fails", "n", F.inline(bits).alias("letter", "bit"))
        .groupBy("part", "letter")
        .agg(F.sum(F.when(hits, F.col("n")).otherwise(0)).alias("failing"), F.sum(F.when(F.col("fails") == F.col("bit"), F.col("n")).otherwise(0)).alias("unique_fails"))
    )
    grid = of_part.select("part", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(factorial(size) - 1))).alias("rank"))
    zeros = grid.select("*", *(F.lit(0).cast("long").alias(s) for s in sums))
    steps = edges.unionByName(zeros).groupBy("part", "step", "rank").agg(*(F.sum(s).alias(s) for s in sums))
    by_rank = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    by_step = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    removed = steps.select("part", "step", "rank", *(F.sum(s).over(by_rank).alias(s) for s in sums))
    removed = removed.withColumn("gone", F.sum("n").over(by_step))
    named = removed.join(ranks, ["rank", "step"]).join(of_filter, ["part", "letter"]).join(of_part, "part")
    return named.select(
        "part",
        "filter_order",
        "step",
        (F.col("documents") - F.col("gone")).alias("kept"),
        F.col("n").alias("removed"),
        (F.col("failing") - F.col("n")).alias("redundant"),
        "unique_fails",
        *(F.col(f"n_{w}").alias(f"{w}_lost") for w in weights),
        F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


def labelled(failed: DataFrame, labels: DataFrame, **flags: Column) -> DataFrame:
    """``failed`` with a boolean for each of ``flags``: whether one of the id's rows in ``labels`` has it."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(f.alias(n) for n, f in flags.items()))
    known = known.groupBy("doc_id").agg(*(F.max(n).alias(n) for n in flags))
    return failed.join(known, "doc_id", "left").select(*failed.columns, *(F.coalesce(n, F.lit(False)).alias(n) for n in flags))
