"""The whole pipeline against SQL for the native stages, brute force and tiktoken for the others."""

import base64

import duckdb
import public_tokenizers
import pyarrow as pa
import tiktoken

import corpus_pipeline
from clientela.llm.oracle import OP3, OP10
from tests.llm.test_pairs_and_passages import brute, classes

SMALL = "/root/testdata/sf0.001"


def test_pipeline_rows(spark):
    db = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    kept = {row[0] for row in db.execute(f"SELECT doc_id FROM ({OP3}) WHERE kept").fetchall()}
    rows = [r for r in db.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if r[0] in kept]
    firsts = [place for _, place in classes([t for _, t in rows], 5, 80)]
    rows = [row for place, row in enumerate(rows, 1) if firsts[place - 1] == place]
    left = brute([t for _, t in rows], 50)
    rows = [(i, words, gone, t) for (i, t), (n, gone, words) in zip(rows, left) if gone == 0 or gone < n]
    db.register("remaining", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] if r[2] else r[3] for r in rows]}))
    db.execute("DROP VIEW documents")
    db.execute("CREATE TABLE documents AS SELECT * FROM remaining")
    held = {row[0] for row in db.execute(OP10).fetchall()}
    expected = {i: (words, None if gone else t) for i, words, gone, t in rows if i not in held}

    content = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert found.keys() == expected.keys() and held and len(found) > 100
    for i, (words, whole) in expected.items():
        text = other.decode(found[i].ids)
        assert b" ".join(text.encode().split()).decode() == words
        assert whole is None or text == whole
        assert found[i].ids == other.encode_ordinary(text) and found[i].n_tokens == len(found[i].ids)
