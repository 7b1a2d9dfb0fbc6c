"""The pipeline's stages on nulls, repeats, empty tables and columns of clashing names."""

import random

import pytest

import corpus_pipeline as P

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rest string, spans long"


def text(seed, n=80):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randrange(10**5)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 1, "r", 2) for r in rows], SCHEMA)


ROWS = [(1, text(1)), (2, text(2)), (2, "short"), (2, text(2)), (3, None), (4, ""), (None, text(9)), (5, text(5)), (6, text(5)), (5, text(5))]


def test_one_row_stands_for_an_id(spark):
    for rows in (ROWS, ROWS[::-1], ROWS[4:] + ROWS[:4]):
        kept = sorted((r.doc_id, r.text) for r in P.one_row_an_id(frame(spark, rows).repartition(3)).collect() if r.text)
        assert kept == [(1, text(1)), (2, min(text(2), "short")), (5, text(5)), (6, text(5))]


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES[:-1]])
def test_stages(spark, stage):
    given = frame(spark, ROWS)
    out = stage(spark, given, SMALL)
    assert out.columns == given.columns
    rows = out.collect()
    assert all(r.rest == "r" and r.spans == 2 for r in rows)
    if stage is P.near_duplicates:
        assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 5]
    if stage is P.quality_rules:
        assert not any(r.text in (None, "", "short") for r in rows)
        assert sorted(r.doc_id for r in rows) == ([1, 2, 5, 6] if min(text(2), "short") == text(2) else [1, 5, 6])
    assert stage(spark, given.limit(0), SMALL).count() == 0


def test_tokens_of_edges(spark):
    rows = P.encoding(spark, frame(spark, ROWS), SMALL).collect()
    assert len(rows) == len(ROWS) - 1 and sum(r.n_tokens == 0 for r in rows) == 2
    assert P.encoding(spark, frame(spark, []), SMALL).count() == 0
