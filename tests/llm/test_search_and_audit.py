"""Exact search, hard negatives and the filter audit against brute force and SQL."""

import math
import random
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import rows_of
from clientela.llm import exact_top_k as E
from clientela.llm import hard_negatives as H
from clientela.llm import vectors as V
from clientela.llm.filter_audit import failures, interactions, intervals, labelled, orders
from clientela.llm.oracle import ORACLE
from clientela.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def rows_with_edges(n, width, seed, labels=3, spread=0.4):
    """Vectors with copies, ties, zeros, short and empty ones, and rows that take no part."""
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) for _ in range(width)], rng.randrange(labels)) for i in range(1, n + 1)]
    for i in range(0, n, 6):  # a group of equal vectors
        rows[i] = (rows[i][0], rows[0][1], rows[i][2])
    rows[5] = (rows[5][0], [0.0] * width, 1)
    rows[7] = (rows[7][0], [0.5], 1)
    rows[9] = (rows[9][0], [], 2)
    rows += [(n + 1, None, 1), (n + 2, [NAN] * width, 1), (n + 3, [1.0] * (width - 1) + [INF], 0), (n + 4, [None] + [1.0] * (width - 1), 0)]
    rows += [(None, [1.0] * width, 1), (n + 5, [1.0] * width, None)]
    return rows


def frame(spark, rows):
    """Further columns have names that the operators use inside."""
    return spark.createDataFrame([(*r, 9, 9, "x") for r in rows], "vec_id long, embedding array<float>, label int, vector int, rank int, leaf string")


def brute_vectors(rows, scale=256):
    out = []
    for i, v, label in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        out.append((i, [math.floor(scale * float(np.float32(x))) for x in v], label))
    return out


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def prepared(df, label=False):
    columns = {"vec_id": F.col("vec_id")} | ({"label": F.col("label").cast("long")} if label else {})
    return V.integer_vectors(df, 256, **columns, vector=F.col("embedding"))


def top_k(rows, modulus, k):
    known = brute_vectors(rows)
    out = []
    for i, v, _ in known:
        if i % modulus == 0:
            best = sorted((-product(v, w), j) for j, w, _ in known if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("n,width,k,block,step", [(400, 20, 5, 64, 4), (120, 3, 7, 4096, 16), (12, 5, 50, 4, 2)])
def test_top_k(spark, monkeypatch, n, width, k, block, step):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "STEP", step)
    rows = rows_with_edges(n, width, seed=n)
    found = E.exact_top_k(prepared(frame(spark, rows)), F.col("vec_id") % 4 == 0, k)
    assert sorted(tuple(r) for r in found.collect()) == top_k(rows, 4, k)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_queries_in_many_chunks(spark, monkeypatch):
    rows = rows_with_edges(150, 6, seed=3)
    limit = 6 * 8 * 10
    monkeypatch.setattr(E, "chunks", lambda df, key: V.chunks(df, key, limit))
    monkeypatch.setattr(H, "chunks", lambda df, key: V.chunks(df, key, limit))
    found = E.exact_top_k(prepared(frame(spark, rows)), F.col("vec_id") % 3 == 0, 4)
    assert sorted(tuple(r) for r in found.collect()) == top_k(rows, 3, 4)
    found = H.hard_negatives(prepared(frame(spark, rows), label=True), F.col("vec_id") % 3 == 0)
    assert sorted(tuple(r) for r in found.collect()) == negatives(rows, 3)


def test_bounds_leave_candidates_out():
    """Candidates in narrow groups: most are ruled out before all dimensions are added up."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (40, 64))
    rows = np.repeat(centres, 100, axis=0) + rng.integers(-5, 5, (4000, 64))
    queries = V.Chunk(np.arange(40) + 10**6, {}, centres)
    best = E.Best(40, 5, np.full(40, np.iinfo(np.int64).min))
    E.search_block(queries, np.arange(2000), rows[::2], best)
    whole = E.search_block(queries, np.arange(2000), rows[1::2], best)
    assert whole < 40 * 2000 / 2
    scores = centres @ np.concatenate((rows[::2], rows[1::2])).T
    assert (np.sort(best.score.reshape(40, 5)) == np.sort(scores, axis=1)[:, -5:]).all()


def test_long_products():
    """Products beyond what doubles hold exactly are still exact; beyond a long they are an error."""
    rows = np.array([[2**30, 1], [2**30, 2], [2**30, 3], [-5, 0]])
    best = E.Best(1, 2, np.array([np.iinfo(np.int64).min]))
    E.search_block(V.Chunk(np.array([99]), {}, np.array([[2**30, 1]])), np.arange(4), rows, best)
    assert list(zip(best.id.tolist(), best.score.tolist())) == [(2, 2**60 + 3), (1, 2**60 + 2)]
    with pytest.raises(OverflowError):
        V.arithmetic(np.array([[2**40]]), np.array([[2**40]]))


def negatives(rows, modulus, low=50, high=95):
    known = [r for r in brute_vectors(rows) if r[2] is not None]
    out = []
    for i, v, label in known:
        if i % modulus:
            continue
        scored = [(-product(v, w), j, other) for j, w, other in known if j != i]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:5]:
            fits = sorted(x for x in scored if x[2] != label and -low * s <= -100 * x[0] <= -high * s)[:3]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("n,width,labels,leaf", [(400, 12, 3, 8), (300, 2, 2, 16), (40, 5, 40, 256), (30, 4, 1, 4)])
def test_hard_negatives(spark, n, width, labels, leaf):
    rows = rows_with_edges(n, width, seed=n + 1, labels=labels)
    found = H.hard_negatives(prepared(frame(spark, rows), label=True), F.col("vec_id") % 5 == 0, leaf=leaf)
    assert sorted(tuple(r) for r in found.collect()) == negatives(rows, 5)


def test_leaves_are_packed_and_boxes_rule_out():
    rng = np.random.default_rng(5)
    rows = np.concatenate([c + rng.integers(-3, 3, (64, 4)) for c in rng.integers(-200, 200, (32, 4))])
    parts = H.tiles(rows, [0, 1, 2], 64)
    assert sorted(np.concatenate(parts).tolist()) == list(range(len(rows))) and max(map(len, parts)) <= 64
    leaf = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.concatenate(parts)
    tree = H.Tree(order, np.zeros(len(order), np.int64), leaf, rows[order], np.float64)
    vector = rows[0].astype(float)
    low, high = tree.bounds(vector[None])
    for node in range(len(parts)):
        scores = tree.rows[tree.begins[node] : tree.ends[node]] @ vector
        assert low[0, node] <= scores.min() and scores.max() <= high[0, node]
    query = H.Query(-1, 1, [-(2**62)], [2**62], 5, same=False)
    looked = H.best_first(tree, vector, low[0].tolist(), high[0].tolist(), query)
    assert looked < len(parts) / 2
    assert query.best[0] == sorted((-int(s), i) for i, s in enumerate(rows @ vector))[:5]


def test_ids_that_repeat_name_the_least_vector(spark):
    rows = [(i, [0.1 * i, 1.0], 0) for i in range(1, 9)]
    again = [(4, [0.9, 0.9], 0)] + [rows[2]] * 50
    for op in (lambda d: E.exact_top_k(prepared(d), F.col("vec_id") == 4), lambda d: H.hard_negatives(prepared(d, True), F.col("vec_id") == 4)):
        assert sorted(op(frame(spark, rows + again)).collect()) == sorted(op(frame(spark, rows)).collect())


def test_no_rows_and_no_queries(spark):
    none = frame(spark, [])
    assert E.exact_top_k(prepared(none), F.lit(True)).count() == 0
    assert H.hard_negatives(prepared(none, True), F.lit(True)).count() == 0
    one = frame(spark, [(1, [1.0, 2.0], 0)])
    assert E.exact_top_k(prepared(one), F.lit(True)).count() == 0
    assert E.exact_top_k(prepared(one), F.lit(False)).count() == 0
    assert H.hard_negatives(prepared(one, True), F.lit(True)).count() == 0


def test_intervals_are_the_orders_in_which_a_set_goes():
    for letters in ("A", "AB", "ABCDE"):
        ranked = dict(orders(letters))
        assert [ranked[r] for r in range(len(ranked))] == sorted("".join(p) for p in permutations(letters))
        spans = intervals(letters)
        covered = [(fails, step, rank) for fails, step, low, high in spans for rank in range(low, high)]
        assert len(covered) == len(set(covered))
        expected = set()
        for fails in range(1, 1 << len(letters)):
            for rank, order in ranked.items():
                step = next(s for s, c in enumerate(order, 1) if fails >> letters.index(c) & 1)
                expected.add((fails, step, rank))
        assert set(covered) == expected
    assert len(spans) == 840


def audit(rows, letters, flag):
    """Every order carried out on every document."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        bits = {c: 1 << i for i, c in enumerate(letters)}
        shapley = dict.fromkeys(letters, 0)
        for order in map("".join, permutations(letters)):
            left = list(own)
            for step, c in enumerate(order, 1):
                fail_all = sum(n for _, f, n, _ in own if f & bits[c])
                here = [r for r in left if r[1] & bits[c]]
                left = [r for r in left if not r[1] & bits[c]]
                removed = sum(r[2] for r in here)
                shapley[c] += removed
                out[part, order, step] = [sum(r[2] for r in left), removed, fail_all - removed, sum(n for _, f, n, _ in own if f == bits[c]), sum(r[2] for r in here if r[3]), c]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return sorted((*k, *v) for k, v in out.items())


@pytest.mark.parametrize("letters", ["ABCDE", "ABC", "A"])
def test_interactions(spark, letters):
    rng = random.Random(len(letters))
    rows = [(rng.choice(["x", "", "hot", "hot"]), rng.randrange(1 << len(letters)), rng.randrange(1, 4), rng.random() < 0.3) for _ in range(300)]
    rows += [("passes all", 0, 2, True)]
    found = interactions(spark.createDataFrame(rows, "part string, fails int, n long, good boolean"), letters, ("good",))
    assert sorted(tuple(r) for r in found.collect()) == audit(rows, letters, "good")


def test_interactions_without_flags_and_rows(spark):
    none = spark.createDataFrame([], "part string, fails int, n long")
    assert interactions(none).count() == 0
    with pytest.raises(ValueError):
        interactions(none, "ABCDEFGHI")


def test_failures(spark):
    varied = " ".join(f"w{i}" for i in range(200))
    texts = {
        1: (varied, 0),
        2: (varied, 16),  # E
        3: (" ".join(f"w{i}" for i in range(199)), 1),  # A
        4: (" ".join(["a", "e", "b", "c"] * 25 + ["d"] * 101), 2),  # B: five of 201 are distinct
        5: (" ".join(f"WXYZ{i}" for i in range(200)), 4),  # C
        6: (varied + " 100 %", 8),  # D
        7: ("", 1),
        8: (None, 17),
        9: ("é" * 300 + " " + varied.replace(" ", "  ") + " ÀÉ", 0),  # non-ASCII capitals and spaces
        10: (" \t\n", 1),
        11: (varied * 3000, 2),
    }
    rows = [(i, t, "s", 7, "x") for i, (t, _) in texts.items()] + [(2, varied, "s", 7, "x"), (None, varied, "s", 7, "x"), (12, varied, None, 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, fails int, part string")
    found = {r.doc_id: (r.part, r.fails, r.n) for r in failures(df, F.col("source")).collect()}
    assert found == {i: ("s", f, 2 if i == 2 else 1) for i, (_, f) in texts.items()} | {12: ("", 16, 1)}


def test_rows_of_the_smallest_id_are_no_copies(spark):
    df = spark.createDataFrame([(3, "t", "a"), (3, "t", "b"), (3, "t", "a"), (5, "t", "a")], "doc_id long, text string, source string")
    found = sorted((r.doc_id, r.part, r.fails, r.n) for r in failures(df, F.col("source")).collect())
    assert found == [(3, "a", 1, 2), (3, "b", 1, 1), (5, "a", 17, 1)]


def test_flags_of_repeated_labels(spark):
    failed = spark.createDataFrame([(1, "p", 1, 1), (2, "p", 0, 1), (4, "p", 0, 1)], "doc_id long, part string, fails int, n long")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    found = {r.doc_id: r.good for r in labelled(failed, labels, good=F.col("quality") == 1).collect()}
    assert found == {1: True, 2: False, 4: False}


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_hard_negatives", "op13_exact_top_k"])
def test_same_as_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    answer = connection.execute(ORACLE[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, answer.fetchall())
