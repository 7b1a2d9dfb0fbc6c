"""Katz backoff over word bigrams: Good-Turing discounted counts, exactly normalised backoff weights.

Texts are tokenised once, into slices of a bounded number of bytes with a dictionary each. Slices ask
for what they need by word and by bigram, the answers come from tables that are partitioned by hash,
and every slice then evaluates its own tokens: P(w | h) is the discounted count of (h, w), or else the
backoff weight of h times P(w), which is the discounted count of w, or else the mass of unknown words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.llm.shared import documents_of, release, removed, slices, stored
from clientela.llm.words import Words, batch, mix, signed, texts_of

SLICE = 8 << 20
# bigrams that one task counts at a time, about
BUCKET = 2_000_000
# counts up to this one get Good-Turing discounts; of larger ones a sliver is set aside, so that no
# context is left without mass to back off with
GOOD_TURING, SLIVER = 5, 0.05
END, START = np.uint64(0xE7D5_0A1B_3C91_77F1), np.uint64(0x51A7_2B4D_96E3_0C5F)
_SLICE = pa.schema([("slice", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("held", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary())])
_SLICE_DDL = "slice long, docs binary, sizes binary, held binary, words binary, tokens binary"


def _pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    held_back: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        docs, sizes, held, hashes = (np.concatenate(x) for x in zip(*held_back))
        words, tokens = np.unique(hashes, return_inverse=True)
        packed = (_pack(docs), _pack(sizes), _pack(held), _pack(words), _pack(tokens.astype(np.uint32)))
        return batch(_SLICE, [number], *[[p] for p in packed])

    for part in slices(batches, "text"):
        words = Words(texts_of(part.column("text")))
        counts = words.counts()
        ends = np.cumsum(counts + 1) - 1
        hashes = np.empty(int(counts.sum()) + len(counts), np.uint64)
        inner = np.ones(len(hashes), bool)
        inner[ends] = False
        hashes[inner], hashes[ends] = words.hashes(fold_case=True), END
        held_back.append((np.asarray(part.column("doc_id")), (counts + 1).astype(np.uint32), np.asarray(part.column("held_out").cast(pa.uint8())), hashes))
        size += part.column("text").nbytes
        if size >= SLICE:
            yield flush()
            held_back, size, number = [], 0, number + 1
    if held_back:
        yield flush()


class Slice:
    """Documents of a slice: tokens as places in its words, and its distinct bigrams in order of key."""

    def __init__(self, row: dict):
        self.id = row["slice"]
        self.docs, self.sizes = _unpack(row["docs"], np.int64), _unpack(row["sizes"], np.uint32).astype(np.int64)
        self.held = _unpack(row["held"], np.uint8).astype(bool)
        # places among words, texts and bigrams of a slice need 32 bits
        self.words, self.tokens = _unpack(row["words"], np.uint64), _unpack(row["tokens"], np.uint32).astype(np.int32)
        self.text = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.trained = ~self.held[self.text]

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.trained], minlength=len(self.words))

    def find_bigrams(self) -> None:
        start = len(self.words)
        pairs = np.empty(len(self.tokens), np.int64)
        pairs[:1], pairs[1:] = start, self.tokens[:-1]
        pairs[np.cumsum(self.sizes)[:-1]] = start
        pairs *= start + 1
        pairs += self.tokens
        pairs, which = np.unique(pairs, return_inverse=True)
        h, w = (pairs // (start + 1)).astype(np.int32), (pairs % (start + 1)).astype(np.int32)
        named = np.append(self.words, START)
        keys = mix(named[h] * np.uint64(0x9E3779B97F4A7C15) + mix(named[w]))
        order = np.argsort(keys)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.bigram, self.keys, self.h, self.w = place[which], keys[order], h[order], w[order]
        self.bigram_counts = np.bincount(self.bigram[self.trained], minlength=len(pairs))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one; lists of numbers as arrays."""
    for part in batches:
        for i in range(part.num_rows):
            row = {}
            for name, column in zip(part.schema.names, part.columns):
                numbers = pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type)
                row[name] = column.slice(i, 1).flatten().to_numpy() if numbers else column[i].as_py()
            yield row


_WORD = pa.schema([("slice", pa.int64()), ("place", pa.int32()), ("w", pa.int64()), ("n", pa.int64())])


def _word_requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        s = Slice(row)
        yield batch(_WORD, np.full(len(s.words), s.id), np.arange(len(s.words)), signed(s.words), s.word_counts())


_BLOCK = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys; buckets are ranges of the key."""
    edges = [(i << 64) // buckets for i in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)])).astype(np.int64)


def _bigram_requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = Slice(row)
            s.find_bigrams()
            bounds = _bucket_bounds(s.keys, buckets)
            full = np.flatnonzero(bounds[1:] > bounds[:-1])
            keys = [_pack(np.diff(s.keys[bounds[b] : bounds[b + 1]], prepend=np.uint64(0))) for b in full]
            counts = [_pack(s.bigram_counts[bounds[b] : bounds[b + 1]]) for b in full]
            yield batch(_BLOCK, full.astype(np.int32), np.full(len(full), s.id), keys, counts)

    return run


_ANSWER_DDL = "slice long, bucket int, counts binary, owned binary, " + ", ".join(f"n{r} long" for r in range(1, GOOD_TURING + 2))
_ANSWER = pa.schema(
    [("slice", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("owned", pa.binary()), *[(f"n{r}", pa.int64()) for r in range(1, GOOD_TURING + 2)]]
)


def _count_bucket(blocks: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's bigrams for each slice that has them; the first of those owns it."""
    blocks = blocks.sort_by("slice").to_pylist()
    keys = [np.cumsum(_unpack(b["keys"], np.uint64), dtype=np.uint64) for b in blocks]
    counts = [_unpack(b["counts"], np.int64) for b in blocks]
    all_counts = np.concatenate(counts)
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, which, all_counts)
    owner = np.full(len(distinct), len(which))
    trained = np.flatnonzero(all_counts)
    np.minimum.at(owner, which[trained], trained)
    owned = np.zeros(len(which), np.uint8)
    owned[owner[owner < len(which)]] = 1
    out, at = [], 0
    for b, k in zip(blocks, keys):
        part = slice(at, at + len(k))
        out.append({"slice": b["slice"], "bucket": b["bucket"], "counts": _pack(total[which[part]]), "owned": _pack(owned[part])})
        at += len(k)
    few = np.bincount(total[total <= GOOD_TURING + 1], minlength=GOOD_TURING + 2)
    out[0] |= {f"n{r}": int(few[r]) for r in range(1, GOOD_TURING + 2)}
    return pa.Table.from_pylist(out, schema=_ANSWER)


def discounts(n: list[int]) -> list[float]:
    """Good-Turing factors of the counts 1 to GOOD_TURING, from the numbers n[r - 1] of each count r.

    Copies of texts can make the numbers too uneven for factors between 0 and 1; then they are first
    smoothed by a straight line through their logarithms. Where that does not fall steeply enough or
    numbers are missing, half a count is taken off.
    """

    def factors(n: list[float]) -> list[float] | None:
        k = len(n) - 1
        common = (k + 1) * n[k] / n[0]
        if common >= 1:
            return None
        found = [((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) for r in range(1, k + 1)]
        return found if all(0 < d < 1 for d in found) else None

    if min(n) > 0:
        logs = np.log(np.arange(1, len(n) + 1))
        slope, height = np.polyfit(logs, np.log(n), 1)
        found = factors(n) or factors(np.exp(height + slope * logs).tolist())
        if found:
            return found
    return [(r - 0.5) / r for r in range(1, len(n))]


def discounted(counts: np.ndarray, factors: list[float]) -> np.ndarray:
    table = np.array([0.0, *factors])
    small = counts <= len(factors)
    return np.where(small, counts * table[np.where(small, counts, 0)], counts - SLIVER)


def discounted_column(count: Column, factors: list[float]) -> Column:
    out = count - F.lit(SLIVER)
    for r, d in enumerate(factors, 1):
        out = F.when(count == r, F.lit(r * d)).otherwise(out)
    return out


_PART = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("doc_id", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("c", pa.float64()), ("n", pa.int64()), ("known", pa.int64())])
_PART_DDL = "kind string, key long, doc_id long, a double, b double, c double, n long, known long"


def _evaluate(facts: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = Slice(row)
            s.find_bigrams()
            c = np.zeros(len(s.words) + 1, np.int64)
            c[row["places"]] = row["totals"]
            c[-1] = facts["trained_docs"]
            r = np.concatenate([_unpack(x["counts"], np.int64) for x in row["answers"]])
            owned = np.concatenate([_unpack(x["owned"], np.uint8) for x in row["answers"]]).astype(bool)
            p1 = np.where(c > 0, discounted(c, facts["words"]) / max(facts["tokens"], 1), facts["unknown"])
            taken = discounted(r, facts["bigrams"])
            # of each context: discounted and whole counts and plain probability of what follows it
            mine = np.flatnonzero(owned)
            by = lambda x: np.bincount(s.h[mine], weights=x[mine], minlength=len(c))
            whole, kept, plain = by(r.astype(float)), by(taken), by(p1[s.w])
            used = np.flatnonzero(whole)
            named = signed(np.append(s.words, START))
            none = np.zeros(len(used))
            yield batch(_PART, ["context"] * len(used), named[used], none.astype(np.int64), whole[used], kept[used], plain[used], none.astype(np.int64), none.astype(np.int64))
            seen = r > 0
            with np.errstate(divide="ignore"):
                term = np.where(seen, np.log10(np.where(seen, taken, 1.0)) - np.log10(np.maximum(c[s.h], 1)), np.log10(p1[s.w]))
            texts = len(s.docs)
            base = np.log10((c + 0.5) / (facts["tokens"] + 0.5 * (facts["distinct"] + 1)))
            sums = [np.bincount(s.text, weights=x, minlength=texts) for x in (base[s.tokens], term[s.bigram], (c[s.tokens] > 0).astype(float))]
            yield batch(_PART, ["document"] * texts, np.arange(texts) + 0, s.docs, sums[0], sums[1], s.held.astype(float), s.sizes, sums[2].astype(np.int64))
            open_tokens = np.flatnonzero(~seen[s.bigram])
            pairs, times = np.unique(s.text[open_tokens].astype(np.int64) * len(c) + s.h[s.bigram[open_tokens]], return_counts=True)
            text, h = pairs // len(c), pairs % len(c)
            h, text, times = (x[c[h] > 0] for x in (h, text, times))  # contexts without counts back off at no cost
            none = np.zeros(len(h))
            yield batch(_PART, ["backoff"] * len(h), named[h], s.docs[text], none, none, none, times, none.astype(np.int64))

    return run


def katz_scores(documents: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows where ``held_out`` (a condition on doc_id) is false and scores all, with
    A-Z in lower case and one end token a text. ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))),
    ``score`` the log10 probabilities of the Katz model; both cover every token. Null and empty texts
    have the end token alone. Rows that repeat under one ``doc_id`` are learnt as often and
    summed into one row. Without training texts the model knows nothing: every token is unknown and certain.
    An empty table gives no rows.
    """
    docs = documents_of(documents).withColumn("held_out", held_out)
    spark = documents.sparkSession
    corpus = stored(docs.mapInArrow(_tokenise, _SLICE_DDL))
    asked = stored(corpus.mapInArrow(_word_requests, "slice long, place int, w long, n long"))
    counts = stored(asked.filter("n > 0").groupBy("w").agg(F.sum("n").alias("n")))
    numbers = [F.count_if(F.col("n") == r) for r in range(1, GOOD_TURING + 2)]
    tokens, distinct, trained, *few = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("w") == int(END.view(np.int64)), F.col("n"))), F.lit(0)), *numbers).first()
    facts = {"tokens": tokens, "distinct": distinct, "trained_docs": trained, "words": discounts(few)}
    mass = counts.agg(F.sum(discounted_column(F.col("n"), facts["words"]))).first()[0] or 0.0
    facts["unknown"] = max(1 - mass / tokens, 1e-12) if tokens else 1.0
    answers = asked.select("slice", "place", "w").join(counts, "w").groupBy("slice").agg(F.collect_list("place").alias("places"), F.collect_list("n").alias("totals"))
    totals = stored(answers)
    release(spark)
    all_tokens = asked.agg(F.count("*")).first()[0]
    buckets = max(1, math.ceil(5 * all_tokens / BUCKET))
    removed(asked)
    blocks = corpus.mapInArrow(_bigram_requests(buckets), "bucket int, slice long, keys binary, counts binary")
    bigrams = stored(blocks.groupBy("bucket").applyInArrow(_count_bucket, _ANSWER_DDL))
    few = bigrams.agg(*[F.coalesce(F.sum(f"n{r}"), F.lit(0)) for r in range(1, GOOD_TURING + 2)]).first()
    facts["bigrams"] = discounts(list(few))
    release(spark)
    by_slice = bigrams.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts", "owned"))).alias("answers"))
    parts = stored(corpus.join(totals, "slice", "left").join(by_slice, "slice").mapInArrow(_evaluate(facts), _PART_DDL))
    removed(corpus, totals, bigrams)
    release(spark)
    contexts = parts.filter("kind = 'context'").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c"))
    weights = contexts.select("key", F.log10(((F.col("a") - F.col("b")) / F.col("a")) / F.greatest(1 - F.col("c"), F.lit(1e-12))).alias("weight"))
    steps = parts.filter("kind = 'backoff'").select("key", "doc_id", "n").join(weights, "key").groupBy("doc_id").agg(F.sum(F.col("n") * F.col("weight")).alias("backoff"))
    whole = parts.filter("kind = 'document'").groupBy("doc_id").agg(F.sum("a").alias("base_score"), F.sum("b").alias("found"), F.max("c").alias("held"), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"))
    return whole.join(steps, "doc_id", "left").select(
        "doc_id", (F.col("held") > 0).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", (F.col("found") + F.coalesce("backoff", F.lit(0.0))).alias("score")
    )
