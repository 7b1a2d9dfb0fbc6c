"""What stages leave in the shared folder when they are done, and joins that shuffle few rows."""

import random
from pathlib import Path

import corpus_pipeline as P
from clientela.llm import shared
from clientela.operators.membership import key_sketch, perhaps_in, surely_out
from tests.llm.test_pairs_and_passages import near_copies


def tables(spark):
    return {p for p in Path(shared.shared_folder(spark).removeprefix("file://")).glob("*")}


def columns(spark, folders):
    return [set(spark.read.parquet(str(p)).columns) for p in folders]


def test_stages_leave_no_working_tables(spark, docs):
    rng = random.Random(1)
    given = docs(near_copies(rng, 40, 8) + near_copies(rng, 20, 3, 300) + near_copies(rng, 20, 60, 300)).select("doc_id", "text", "lang", "source", "n_chars")
    before = tables(spark)
    near = P.near_duplicates(spark, given, "").collect()
    left = columns(spark, tables(spark) - before)
    assert 0 < len(near) < 80 and not any({"sig"} & c or {"elements"} & c or {"linked"} & c for c in left)
    before = tables(spark)
    assert P.substring_dedup(spark, given, "").count() > 0
    assert not any({"anchor"} & c or {"w"} & c for c in columns(spark, tables(spark) - before))


def test_removed_deletes_the_table(spark):
    stored = shared.stored(spark.range(3))
    path = Path(stored.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent
    assert path.exists()
    shared.removed(stored)
    assert not path.exists()


def test_without(spark, monkeypatch):
    rows = spark.createDataFrame([(i, str(i)) for i in [*range(1000), 5, None]], "k long, v string")
    keys = shared.stored(spark.range(0, 1000, 3).withColumnRenamed("id", "k"))
    expected = sorted([i for i in [*range(1000), 5] if i % 3] + [-1])
    for most in (shared.SKETCHED_KEYS, 1):
        monkeypatch.setattr(shared, "SKETCHED_KEYS", most)
        found = shared.without(rows, keys, "k")
        assert found.columns == ["k", "v"]
        assert sorted(-1 if r.k is None else r.k for r in found.collect()) == expected
        near = {r.k for r in shared.narrowed(rows, keys, "k").collect()}
        assert near >= set(range(0, 1000, 3))
    sketch = key_sketch(keys, "k")
    assert perhaps_in(rows, "k", sketch).count() + surely_out(rows, "k", sketch).count() == 1002
    assert shared.without(rows, shared.stored(keys.limit(0)), "k").count() == 1002
