"""Scores on held-out rows, exact round trips and brute-force versions."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from clientela.llm import byte_bpe, compression_quality, html_extraction, katz, queries, toxicity
from clientela.llm.shared import fold

SMALL = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"


def test_katz_against_brute_force(spark, docs):
    texts = [r.text for r in spark.read.parquet(f"{TINY}/documents.parquet").limit(150).collect()] + [None, "", "Unseen words\tonly\n"]
    found = {r.doc_id: r for r in katz.katz_scores(docs(texts), fold(5) == 1).collect()}
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = {i: (t or "").encode().translate(lower).split() + [None] for i, t in enumerate(texts, 1)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    one, two = Counter(), Counter()
    for i, w in words.items():
        if not held[i]:
            one.update(w)
            two.update(zip([0, *w[:-1]], w))
    total, distinct = sum(one.values()), len(one)
    d1, d2 = (katz.discounts([Counter(c.values())[r] for r in range(1, 7)]) for c in (one, two))
    left = lambda c, d: c * d[c - 1] if c <= 5 else c - katz.SLIVER
    unknown = 1 - sum(left(c, d1) for c in one.values()) / total
    p1 = lambda w: left(one[w], d1) / total if w in one else unknown
    whole, kept, plain = Counter(), Counter(), Counter()
    for (h, w), c in two.items():
        whole[h] += c
        kept[h] += left(c, d2)
        plain[h] += p1(w)
    weight = lambda h: (1 - kept[h] / whole[h]) / (1 - plain[h]) if whole[h] else 1
    p2 = lambda h, w: left(two[h, w], d2) / whole[h] if (h, w) in two else weight(h) * p1(w)
    for h in [0, *list(one)[:5]]:
        assert sum(p2(h, w) for w in one) + weight(h) * unknown == pytest.approx(1)
    for i, w in words.items():
        row = found[i]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[i], len(w), sum(x in one for x in w), total)
        assert row.base_score == pytest.approx(sum(math.log10((one[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w))
        assert row.score == pytest.approx(sum(math.log10(p2(h, x)) for h, x in zip([0, *w[:-1]], w)))
    assert katz.katz_scores(docs([]), fold(5) == 1).count() == 0


def test_discounts_are_discounts():
    for n in ([100, 30, 15, 9, 6, 4], [100, 90, 15, 9, 6, 4], [5, 6, 7, 8, 9, 9], [3, 0, 0, 0, 0, 0]):
        assert all(0 < d < 1 for d in katz.discounts(n))


def test_bpe_as_tiktoken(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    content = byte_bpe.read_ranks(path)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "hello  world\n\n", "naïve ÉÇñ 日本語 🙂 \u0000", "<|endoftext|>", "aaaaaaaaaaaabababab", "x" * 3000, "it's 12345 we'LL", "zqxj" * 40]
    df = byte_bpe.decode(byte_bpe.encode(docs(texts + texts), content, public_tokenizers.PATTERN), content, public_tokenizers.PATTERN)
    rows = {r.doc_id: r for r in df.collect()}
    assert len(rows) == 2 * len(texts)
    for i, t in enumerate(texts + texts, 1):
        assert rows[i].ids == other.encode_ordinary(t or "") and bytes(rows[i].decoded) == (t or "").encode()
    digest = byte_bpe.digests(df).filter("doc_id = 1").first()
    assert digest.n_tokens == 0 and digest.ids_sha256 == digest.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert byte_bpe.encode(docs([]), content, public_tokenizers.PATTERN).count() == 0


def test_bpe_takes_one_worker_a_task(spark, docs):
    """Encoding and decoding in a row were two Python workers a task, each with its own DuckDB and pieces."""
    content = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    given = docs([None, "", "hello  world\n", "naïve 日本語 🙂", "it's 12345 " * 50, "hello  world\n"])
    one = byte_bpe.round_trip(given, content, public_tokenizers.PATTERN)
    two = byte_bpe.decode(byte_bpe.encode(given, content, public_tokenizers.PATTERN), content, public_tokenizers.PATTERN)
    assert sorted(one.collect()) == sorted(two.collect())
    for df in (queries.op6_byte_bpe(spark, TINY), corpus_pipeline.encoding(spark, given, TINY)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies</div><nav><ul><li>a<li>b</ul></nav><div class="main-col"><h2>Head &amp; {0}</h2>
<p>One <b>two</b>
 {1}<p>Four&nbsp;five &#233;<br>six{1}<ul><li>x{1}<li>y{0}</ul><form><input><label>name</label></form>
<p>Share this page<script>var a="<p>no</p>"</script><aside>side</aside></div><section id="comments"><article class="comment"><p>bad</p></article></section>
<footer>foot</footer></body></html>"""


def test_main_text(spark):
    pages = [(i, f"http://h.org/{i}", PAGE.format(f"n{i}", f"m{i}")) for i in range(12)]
    pages += [(50, "http://x.org/", PAGE.format("a", "b")), (51, None, None), (52, "http://h.org/e", ""), (53, "http://y.org", "plain < text &lt;b&gt;"), (54, "http://y.org", "<p>a<div>b")]
    pages += [pages[3]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))
    found = {}
    for r in html_extraction.extract(df).collect():
        assert found.setdefault(r.page_id, r.text) == r.text
    varying = "Head & n3\n\nOne two m3\n\nFour five é sixm3\n\nxm3\n\nyn3"
    assert found[3] == varying  # what all pages of the host share is template
    assert found[50].endswith("Share this page") and found[50].startswith("Head & a\n\nOne two b")
    assert found[51] == found[52] == "" and found[53] == "plain < text <b>" and found[54] == "a\n\nb"
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_articles_of_the_table(spark):
    rows = queries.op7_html_extraction(spark, TINY).collect()
    assert rows and all(r.n_chars == len(r.text) and r.text for r in rows)


def accuracy(spark, query, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = [r for r in query(spark, SMALL).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    return sum(a == b for a, b in held) / len(held), len(held)


def test_quality_on_held_out_rows(spark):
    share, n = accuracy(spark, queries.op5_quality_classifier, "quality")
    assert n > 60 and share > 0.88


def test_toxicity_on_held_out_rows(spark):
    share, n = accuracy(spark, queries.op8_toxicity, "toxic")
    assert n > 40 and share > 0.9


def test_restored_words(spark):
    model = toxicity.character_model(spark.read.parquet(f"{SMALL}/documents.parquet"))
    for written, meant in {"1d10t": "idiot", "idiooot": "idiot", "i d i o t": "idiot", "i.d.i.o.t": "idiot", "m0r0n!!": "moron", "stup1d": "stupid", "hello": "hello", "2024": "2024"}.items():
        assert toxicity.restored(written, model) == meant


def test_restored_spacing_and_doubling(spark):
    model = toxicity.character_model(spark.read.parquet(f"{SMALL}/documents.parquet"))
    for written in ("iddiot", "i.d.i.ot", "i d i ot", "id i ot"):
        assert "idiot" in {w for t in toxicity.words_of(f"reading {written} there") for w in toxicity.features_of(t, model)}, written
    for written in ("stuupid", "st.upid", "st-up-id", "s-t-uu-p-i-d", "st u p i d", "s tu p id", "is a st u p i d"):
        assert "stupid" in {w for t in toxicity.words_of(f"reading {written} there") for w in toxicity.features_of(t, model)}, written
    assert toxicity.restored("hello", model) == "hello"


def test_plain_words_cost_little(monkeypatch):
    """Words in one reading build no lattice, and those no feature begins like no stems; sums are those of all features."""
    model = np.log(np.random.default_rng(3).dirichlet(np.ones(toxicity.SYMBOLS), (toxicity.SYMBOLS, toxicity.SYMBOLS)))
    weights = {"idiot": 3.5, "idio…": 2.25, "moron": -1.5, "日本語": 2.0}
    texts = ["plain words of letters", "1d10t and i.d.i.o.t or i d i o t", "Moron!", "morons", "日本語 x", "", "+ ,. ,!i", "a feebly noon"]
    heaviest = lambda t: max((weights.get(f, 0.0) for f in toxicity.features_of(t, model)), default=0.0)
    wanted = [min(10.0, math.fsum(map(heaviest, toxicity.words_of(t)))) for t in texts]
    looked, read = [], []
    stems, lattice = toxicity.stems, toxicity.lattice
    monkeypatch.setattr(toxicity, "stems", lambda w: looked.append(w) or stems(w))
    monkeypatch.setattr(toxicity, "lattice", lambda w: read.append(w) or lattice(w))
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    (out,) = toxicity._sums(model, weights)(iter([rows]))
    assert out.column("x").to_pylist() == wanted
    assert {w[:3] for w in looked} <= {"idi", "mor", "日本語"} and not {"plain", "words", "morons"} & set(read)


def test_models_without_labels_or_texts(spark, docs):
    none = spark.createDataFrame([], "doc_id long, label int")
    some = docs([None, "", "a few words", "a few words"])
    for module in (compression_quality, toxicity):
        rows = module.score(some, module.fit(some, none)).collect()
        assert len(rows) == 4 and {r.score for r in rows} == {0.5}
        assert module.score(docs([]), module.fit(docs([]), none)).count() == 0
    one = spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, label int")
    assert {r.predicted for r in toxicity.score(some, toxicity.fit(some, one)).collect()} == {1}


def test_pipeline(spark, tmp_path):
    """Stages keep what their operators say; columns stay those of documents until the last."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, SMALL)
        path = str(tmp_path / name)
        out.write.parquet(path)
        given = spark.read.parquet(path)
        kept.append(given)
    assert [len(corpus_pipeline.STAGES)] == [5] and all(k.columns == docs.columns for k in kept[:-1])
    sizes = [k.count() for k in kept]
    assert docs.count() > sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4] > 0
    assert kept[0].subtract(docs).count() == 0 and kept[1].subtract(kept[0]).count() == 0
    assert kept[3].join(kept[2], docs.columns, "left_anti").count() == 0
    texts = {r.doc_id: r.text for r in kept[3].collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in kept[4].collect())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(texts)
