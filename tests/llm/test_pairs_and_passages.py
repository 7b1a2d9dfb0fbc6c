"""Jaccard classes and repeated passages against brute force."""

import random

import numpy as np
import pytest

from clientela.llm import jaccard_join as J
from clientela.llm.components import components
from clientela.llm.substring_dedup import remove_repeats

WORDS = [f"w{i}" for i in range(400)]


def near_copies(rng, n, edits, length=120):
    base = [rng.choice(WORDS) for _ in range(length)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(len(t))] = rng.choice(WORDS)
        out.append(" ".join(t))
    return out


def classes(texts, width, share):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    sets = [grams(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= share * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i) + 1) for i, s in enumerate(sets)]


@pytest.mark.parametrize("width,threshold,share", [(3, "0.9", 90), (5, "0.8", 80), (2, "0.5", 50)])
def test_classes(docs, width, threshold, share):
    rng = random.Random(width)
    texts = near_copies(rng, 60, 8) + near_copies(rng, 20, 3, 15) + near_copies(rng, 15, 2, 700)
    texts += [None, "", "  \n", "one", "ONE", "one two", "a b c", "A B C"] + near_copies(rng, 30, 30)
    rng.shuffle(texts)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_classes(docs(texts), width, threshold).collect()}
    assert [found[i + 1] for i in range(len(texts))] == classes(texts, width, share)


def test_pairs_of_many_shared_signatures_are_looked_at_once(spark):
    """Forty texts share most of thirty signatures; a hub shares one with each of forty others, which share none."""
    alike = [(1000 + s, i, i) for s in range(30) for i in range(1, 41) if (i * s) % 7]
    hub = [(2000 + i, d, d) for i in range(40) for d in (101, 200 + i)]
    members = spark.createDataFrame(alike + hub, "sig long, doc_id long, class long")

    def pairs(rows):
        other = rows.selectExpr("sig", "doc_id AS w", "class AS other")
        return [tuple(r) for r in rows.join(other, "sig").filter("class < other").select("doc_id", "w").collect()]

    before, after = pairs(members), pairs(J._crowds(members))
    assert set(before) <= set(after) and len(before) > 10 * 40 * 39 / 2
    assert len(after) <= 40 * 39 / 2 + 40 and all(u == 101 for u, v in after if v >= 200)


def test_classes_without_chains(docs):
    """All pairs are left to the last look."""
    rng = random.Random(6)
    texts = [t for _ in range(3) for t in near_copies(rng, 40, 14)] + near_copies(rng, 10, 40, 700)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_classes(docs(texts), 5, "0.8", 0).collect()}
    assert [found[i + 1] for i in range(len(texts))] == classes(texts, 5, 80)


def test_repeated_rows_and_empty_tables(docs):
    rows = J.jaccard_classes(docs(["a b c d", "a b c d", "x"], ids=[7, 7, 3]), 3, "0.9").collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(3, 3), (7, 7), (7, 7)]
    assert J.jaccard_classes(docs([]), 3, "0.9").count() == 0
    assert remove_repeats(docs([])).count() == 0


def test_linked_sets_share_a_signature():
    """Whole segments and one-deletion neighbourhoods alike, for sets as far apart as they may be."""
    rng = np.random.default_rng(4)
    for deletions_cheap in (0, 10**9):
        bands = J.plan_bands(400, J.Fraction("0.8"), {k: deletions_cheap for k in range(60)})
        lows = [b.low for b in bands]
        kinds = set()
        for size in (1, 3, 5, 9, 20, 47, 150, 300):
            for _ in range(20):
                a = rng.integers(0, 2**63, size, dtype=np.uint64)
                fresh = rng.integers(0, 2**63, size // 9, dtype=np.uint64)
                b = np.unique(np.concatenate((a[len(fresh) :], fresh)))
                a = np.unique(a)
                both = len(np.intersect1d(a, b))
                assert 10 * both >= 8 * (len(a) + len(b) - both)
                g = np.searchsorted(lows, min(len(a), len(b)), "right") - 1
                kinds.add(bands[g].deletions)
                assert np.intersect1d(J.signatures_of(a, g, bands[g]), J.signatures_of(b, g, bands[g])).size
        assert deletions_cheap == 0 or True in kinds


def test_sketch_never_overstates():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    b = np.unique(np.concatenate((a[40:], rng.integers(0, 2**63, 30, dtype=np.uint64))))
    bits = sum(int(x).bit_count() for x in J.sketch_of(a) ^ J.sketch_of(b))
    assert 0 < bits <= len(np.setxor1d(a, b))


def test_wide_sketch_folds_and_never_overstates():
    rng = np.random.default_rng(7)
    limit = J.Fraction("0.8")
    assert J.words_of(0, limit) == J.words_of(700, limit) == J.SKETCH < J.words_of(3000, limit) < J.words_of(90_000, limit)
    a = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    b = np.unique(np.concatenate((a[400:], rng.integers(0, 2**63, 300, dtype=np.uint64))))
    wide = J.sketch_of(a, 8 * J.SKETCH)
    for words in (J.SKETCH, 2 * J.SKETCH, 8 * J.SKETCH):
        assert (J.folded(wide, words) == J.sketch_of(a, words)).all()
        bits = int(np.bitwise_count(J.folded(wide, words) ^ J.sketch_of(b, words)).sum())
        assert 0 < bits <= len(np.setxor1d(a, b))


@pytest.fixture
def written(monkeypatch):
    """Rows of the working tables that the join has written, by their columns."""
    rows, real = {}, J.stored

    def stored(df, *by):
        out = real(df, *by)
        key = tuple(out.columns)
        rows[key] = rows.get(key, 0) + out.count()
        return out

    monkeypatch.setattr(J, "stored", stored)
    return rows


def test_long_texts_that_share_a_passage_are_not_compared(docs, written):
    """Forty of them share signatures, which makes hundreds of pairs; only near copies are worth their elements."""
    rng = random.Random(8)
    passage = [rng.choice(WORDS) for _ in range(300)]
    texts = [" ".join([str(rng.randrange(10**6)) for _ in range(3000)] + passage) for _ in range(40)]
    texts += near_copies(rng, 3, 4, 3000)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_classes(docs(texts), 5, "0.8").collect()}
    assert [found[i + 1] for i in range(len(texts))] == classes(texts, 5, 80)
    assert 2 <= written["u", "v", "linked"] <= 6
    assert written["doc_id", "elements"] <= 9


def test_copies_of_a_text_write_no_signatures(docs, written):
    copies = docs(near_copies(random.Random(9), 1, 0, 300) * 60).repartition(6)
    assert {r.component_id for r in J.jaccard_classes(copies, 5, "0.8").collect()} == {1}
    assert written["sig", "doc_id"] == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(found[i] == 1 for i in range(1, 41))
    assert found[100] == found[101] == 100 and found[200] == 200


def brute(texts, width):
    words = [(t or "").encode().split() for t in texts]
    first = {}
    for i, w in enumerate(words):
        for p in range(len(w) - width + 1):
            first.setdefault(tuple(w[p : p + width]), i)
    out = []
    for i, w in enumerate(words):
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < i:
                gone.update(range(p, p + width))
        out.append((len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return out


@pytest.mark.parametrize("width,gram", [(50, 8), (12, 4), (5, 5)])
def test_passages(docs, width, gram):
    rng = random.Random(width)
    passage = " ".join(rng.choice(WORDS) for _ in range(3 * width))
    other = " ".join(rng.choice(WORDS) for _ in range(width))
    texts = [None, "", "x " * (2 * width), " ".join(rng.choice(WORDS) for _ in range(200))]
    for _ in range(40):
        head, tail = (" ".join(rng.choice(WORDS) for _ in range(rng.randrange(30))) for _ in range(2))
        cut = passage.split()[rng.randrange(width) : 3 * width - rng.randrange(width)]
        texts.append(f"{head}\n{' '.join(cut)}\n\n{other if rng.random() < 0.3 else ''} {tail}")
    texts += near_copies(rng, 15, 3, 4 * width) + [texts[5], "x " * (2 * width)]
    found = {r.doc_id: r for r in remove_repeats(docs(texts), width, gram, ["n_chars", "u"]).collect()}
    for i, (n, gone, kept) in enumerate(brute(texts, width)):
        row = found[i + 1]
        assert (row.n_words, row.n_removed, " ".join(row.text.split())) == (n, gone, kept)
        assert sum(s.end - s.first for s in row.spans) == gone and row.rest == (1, 2)
        assert gone or row.text == (texts[i] or "")
