"""What a Python worker keeps between tasks."""

import public_tokenizers
import pyarrow as pa

from clientela.llm import byte_bpe, shared


def test_a_worker_drops_the_tokenizer_for_other_operators():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["Some words, and some more words"]})
    engine = byte_bpe._engine(ranks, public_tokenizers.PATTERN)
    assert next(byte_bpe._decoded(engine, byte_bpe._encoded(engine, iter([batch])))).column("decoded").to_pylist() == [b"Some words, and some more words"]
    assert byte_bpe._engine(ranks, public_tokenizers.PATTERN) is engine
    engine.before = {"x": b""}
    engine.rest()
    assert not engine.before
    list(shared.slices(iter([batch]), "text"))
    assert not shared._held
