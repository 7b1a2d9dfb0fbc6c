"""Repeated-phrase automata: passages that recur in other documents are confirmed, compiled into
Aho-Corasick automata and located in every document.

Every window of ``width`` words belongs to the anchor (the ``gram``-word phrase of least hash) that it
contains, and the consecutive windows of one anchor are a passage. Equal windows have equal anchors, so
only passages of one anchor need comparing: passages that recur as a whole are confirmed by their
hash, and only where one anchor has different passages are their windows compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientela.llm.shared import documents_of, narrowed, release, removed, slices, stored
from clientela.llm.words import Words, batch, mix, sequence_hashes, signed, texts_of, windows

# bits of a sort key that hold a word's position; the others hold the head of the phrase's hash
_PLACE = np.uint64((1 << 28) - 1)
# bytes of text that share an automaton
AUTOMATON_BYTES = 1 << 20


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from minima of blocks read both ways."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Passages:
    """Passages of a run of texts: text, first word, end word, anchor and hash of each."""

    def __init__(self, texts: list[bytes], width: int, gram: int):
        self.words = Words(texts)
        self.hashes = self.words.hashes(fold_case=False)
        starts, text = windows(self.words.first, width)
        if not len(starts):
            self.text = self.low = self.high = np.empty(0, np.int64)
            self.anchor = self.key = np.empty(0, np.uint64)
            return
        at = np.arange(len(self.hashes) - gram + 1)
        grams = sequence_hashes(self.hashes, at, at + gram)
        least = _sliding_minimum((grams & ~_PLACE) | at.astype(np.uint64), width - gram + 1)
        place = (least[starts] & _PLACE).astype(np.int64)
        begins = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
        ends = np.concatenate((begins[1:], [len(starts)])) - 1
        self.text, self.low, self.high = text[begins], starts[begins], starts[ends] + width
        self.anchor = grams[place[begins]]
        offset = (place[begins] - self.low).astype(np.uint64)
        self.key = mix(sequence_hashes(self.hashes, self.low, self.high) ^ mix(offset + np.uint64(1)))


_FOUND = pa.schema([("anchor", pa.int64()), ("passage", pa.int64()), ("doc_id", pa.int64())])
_WINDOW = pa.schema([("w", pa.int64()), ("doc_id", pa.int64())])


def _find(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            docs = np.asarray(part.column("doc_id"))
            p = Passages(texts_of(part.column("text")), width, gram)
            yield batch(_FOUND, signed(p.anchor), signed(p.key), docs[p.text])

    return run


def _window_hashes(p: Passages, chosen: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every window of the chosen passages."""
    counts = p.high[chosen] - p.low[chosen] - width + 1
    at = np.repeat(p.low[chosen], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return sequence_hashes(p.hashes, at, at + width), at


def _open_windows(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            docs = np.asarray(part.column("doc_id"))
            p = Passages(texts_of(part.column("text")), width, gram)
            wanted = [set(x) for x in part.column("passages").to_pylist()]
            chosen = np.array([i for i, (t, k) in enumerate(zip(p.text.tolist(), signed(p.key).tolist())) if k in wanted[t]], np.int64)
            if len(chosen):
                hashes, _ = _window_hashes(p, chosen, width)
                owner = np.repeat(docs[p.text[chosen]], p.high[chosen] - p.low[chosen] - width + 1)
                yield batch(_WINDOW, signed(hashes), owner)

    return run


def _spans(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [{"first": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2])]


def _without(words: Words, i: int, spans: list[dict]) -> bytes:
    """A text without the words of some spans and the white space after them."""
    first, end = words.first[i], words.first[i + 1]
    low, out = words.begins[i], []
    for s in spans:
        out.append(words.data[low : words.starts[first + s["first"]]].tobytes())
        low = words.starts[first + s["end"]] if first + s["end"] < end else words.begins[i + 1] - 1
    out.append(words.data[low : words.begins[i + 1] - 1].tobytes())
    return b"".join(out)


_KEPT = [("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))]


def _remove(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", AUTOMATON_BYTES):
            docs, texts = part.column("doc_id").to_pylist(), texts_of(part.column("text"))
            whole = [dict(zip(k or (), v or ())) for k, v in zip(part.column("passages").to_pylist(), part.column("passage_docs").to_pylist())]
            single = [dict(zip(k or (), v or ())) for k, v in zip(part.column("ws").to_pylist(), part.column("w_docs").to_pylist())]
            marked = any(whole) or any(single)
            p = Passages(texts, width, gram) if marked else None
            masks = _locate(docs, p, whole, single, width) if marked else {}
            kept, removed, spans = [], [], []
            words = p.words if p else Words(texts)
            for i, t in enumerate(texts):
                mask = masks.get(i)
                removed.append(0 if mask is None else int(mask.sum()))
                spans.append([] if mask is None else _spans(mask))
                kept.append((t if mask is None else _without(words, i, spans[-1])).decode())
            counts = words.counts()
            columns = [part.column("doc_id"), kept, counts, removed, spans]
            fields = list(_KEPT)
            if "rest" in part.schema.names:
                columns.append(part.column("rest"))
                fields.append(("rest", columns[-1].type))
            schema = pa.schema(fields)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _locate(docs: list[int], p: Passages, whole: list[dict], single: list[dict], width: int) -> dict[int, np.ndarray]:
    """Words to remove of each text of the slice, from one automaton over its confirmed passages."""
    _, ids = np.unique(p.hashes, return_inverse=True)
    ids = ids.tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    keys, texts = signed(p.key).tolist(), p.text.tolist()
    rest = []
    for i, (t, k) in enumerate(zip(texts, keys)):
        least = whole[t].get(k)
        if least is not None:
            automaton.add_word(tuple(ids[p.low[i] : p.high[i]]), (int(p.high[i] - p.low[i]), least))
        elif single[t]:
            rest.append(i)
    if rest:
        chosen = np.array(rest)
        hashes, at = _window_hashes(p, chosen, width)
        owner = np.repeat(p.text[chosen], p.high[chosen] - p.low[chosen] - width + 1)
        for h, a, t in zip(signed(hashes).tolist(), at.tolist(), owner.tolist()):
            least = single[t].get(h)
            if least is not None:
                automaton.add_word(tuple(ids[a : a + width]), (width, least))
    masks: dict[int, np.ndarray] = {}
    if not len(automaton):
        return masks
    automaton.make_automaton()
    first = p.words.first.tolist()
    for i, doc in enumerate(docs):
        low, high = first[i], first[i + 1]
        if high - low < width:
            continue
        mask = None
        for end, (size, least) in automaton.iter(tuple(ids[low:high])):
            if doc > least:
                if mask is None:
                    mask = masks[i] = np.zeros(high - low, bool)
                mask[end + 1 - size : end + 1] = True
    return masks


def remove_repeats(documents: DataFrame, width: int = 50, gram: int = 8, rest: list[str] | None = None) -> DataFrame:
    """(doc_id, text, n_words, n_removed, spans): documents without passages that smaller ids have.

    A window is ``width`` consecutive words of one document. Each word is removed that a window covers
    whose word sequence also starts in a document with a smaller ``doc_id``; windows are judged on the
    input. ``text`` has the kept words with the white space before them, ``spans`` the removed word
    ranges (first, end). Null texts have no words; texts of fewer words than a window lose none; rows that repeat are
    judged alike and none counts against its own ``doc_id``. Columns named in ``rest`` are carried
    along in a struct ``rest``; others are ignored. An empty table gives no rows.
    """
    carried = [F.struct(*[F.col(c) for c in rest]).alias("rest")] if rest else []
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carried).filter("doc_id IS NOT NULL")
    plain = documents_of(documents)
    found = stored(plain.mapInArrow(_find(width, gram), "anchor long, passage long, doc_id long"))
    by_passage = stored(found.groupBy("anchor", "passage").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")))
    # an anchor with several passages: their windows have to be compared one by one
    several = by_passage.groupBy("anchor").agg(F.count("*").alias("n"), F.min("least").alias("a"), F.max("most").alias("b")).filter("n > 1 AND a < b")
    split = by_passage.join(several.select("anchor"), "anchor", "left_semi").select("passage", F.col("least").alias("doc_id")).distinct()
    split = stored(split.groupBy("doc_id").agg(F.collect_list("passage").alias("passages")))
    opened = stored(narrowed(plain, split, "doc_id").join(split, "doc_id").mapInArrow(_open_windows(width, gram), "w long, doc_id long").distinct())
    least = opened.groupBy("w").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("w", "least")
    ws = opened.join(least, "w").filter("doc_id > least").groupBy("doc_id").agg(F.collect_list("w").alias("ws"), F.collect_list("least").alias("w_docs"))
    recurring = by_passage.filter("least < most").select("anchor", "passage", "least")
    marks = found.join(recurring, ["anchor", "passage"]).filter("doc_id > least").select("doc_id", "passage", "least").distinct()
    marks = marks.groupBy("doc_id").agg(F.collect_list("passage").alias("passages"), F.collect_list("least").alias("passage_docs"))
    marks = stored(marks.join(ws, "doc_id", "full"))
    removed(found, by_passage, split, opened)
    release(documents.sparkSession)
    ddl = "doc_id long, text string, n_words long, n_removed long, spans array<struct<first:long,end:long>>"
    if rest:
        ddl += f", rest {docs.schema['rest'].dataType.simpleString()}"
    return docs.join(marks, "doc_id", "left").mapInArrow(_remove(width, gram), ddl)
