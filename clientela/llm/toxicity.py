"""Toxicity by a noisy channel: leetspeak, spacing and repetition are undone by a Viterbi search over
character lattices under a character language model, then the restored words are scored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.llm.compression_quality import logistic
from clientela.llm.shared import documents_of, slices, stored
from clientela.llm.words import batch, texts_of

# fixed values: what a sign may stand for
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = " .-_*~·,/\\'"
# costs of the channel, in nats
DOUBLED, SHORTENED, SIGN, LITERAL, JOINED, APART = 0.7, 0.5, 0.7, 6.0, 0.2, 2.5
# the language model knows a boundary, 26 letters and other letters
SYMBOLS = 28
_EDGE = re.compile(r"^[^\w@$€£]+|[^\w@$!€£+|]+$")
_JUNK = re.compile(r"([^\w])\1+$|^([^\w])\2+")
_SPACED = re.compile(r"[^\W_][.\-_*~·,/\\']+[^\W_]")
_RUN = re.compile(r"([^\W\d_])\1")
# letters of a fragment that may belong to lone letters beside it
FRAGMENT = 3
_COUNTS = pa.schema([("code", pa.int32()), ("n", pa.int64())])
# words whose weight a worker remembers
REMEMBERED = 300_000

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for part in slices(batches, "text"):
        codes = _CLASS[np.frombuffer(b"  ".join([b"", *texts_of(part.column("text")), b""]), np.uint8)]
        codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]  # one boundary between words
        if len(codes) > 2:
            total += np.bincount((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:], minlength=SYMBOLS**3)
    used = np.flatnonzero(total)
    yield batch(_COUNTS, used, total[used])


# numbers of :func:`character_model`, as an array or, faster to look up one at a time, as lists of lists
Characters = np.ndarray | list[list[list[float]]]


def character_model(documents: DataFrame) -> np.ndarray:
    """Log probabilities of a symbol after two others, from all texts; 28**3 numbers in all."""
    rows = documents_of(documents).mapInArrow(_count_trigrams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for code, n in rows:
        counts[code] = n
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    return np.log((three + 5 * p2) / (three.sum(2, keepdims=True) + 5))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each run of a token's characters may have been, with its cost; a space is a boundary."""
    out = []
    for c, run in groupby(token):
        n = len(list(run))
        if c.isalpha():
            options = [(c, 0.0)] if n == 1 else [(c + c, 0.0), (c, SHORTENED + 1)] if n == 2 else [(c, SHORTENED), (c + c, DOUBLED)]
        elif c in LEET:
            options = [(x, SIGN) for x in LEET[c]] + ([(x + x, SIGN + (0 if n == 2 else DOUBLED)) for x in LEET[c]] if n > 1 else []) + [(" ", LITERAL)]
        elif c in SEPARATORS:
            options = [("", JOINED), (" ", APART)]
        else:
            options = [(" ", 0.0)]
        out.append(options)
    return out


def viterbi(steps: list[list[tuple[str, float]]], model: Characters) -> str:
    """The likeliest reading of a lattice; of equally likely ones the first in order of letters."""
    best = {(0, 0): (0.0, "")}
    for options in [*steps, [(" ", 0.0)]]:
        then: dict[tuple[int, int], tuple[float, str]] = {}
        read = [(letters, price, [_symbol(c) for c in letters]) for letters, price in options]
        for (a, b), (cost, text) in best.items():
            for letters, price, symbols in read:
                x, y, total = a, b, cost + price
                for s in symbols:
                    if s == y == 0:
                        continue
                    total -= model[x][y][s]
                    x, y = y, s
                entry = (total, text + letters)
                if (x, y) not in then or entry < then[x, y]:
                    then[x, y] = entry
        best = then
    return " ".join(min(best.values())[1].split())


def needs_decoding(word: str) -> bool:
    """Whether a lattice of the word has more than one path worth weighing."""
    if word.isalpha():
        return bool(_RUN.search(word))  # letters are neither signs nor separators
    signs = sum(c in LEET for c in word)
    letters = sum(c.isalpha() for c in word)
    return bool(signs and 2 * letters >= signs or _RUN.search(word) or _SPACED.search(word))


def trimmed(token: str) -> str:
    if token.isalnum():
        return token
    return _EDGE.sub("", _JUNK.sub("", token))


def words_of(text: str) -> set[str]:
    """Distinct tokens of a text in lower case; lone letters in a row also as one spaced token, alone and
    with the short fragments between and beside them."""
    tokens = text.lower().split()
    out = set(tokens)
    alone = [i for i, t in enumerate(tokens) if len(t) == 1]
    rows: list[list[int]] = []
    chains: list[list[int]] = []
    for i in alone:
        if rows and i - rows[-1][1] == 1:
            rows[-1][1] = i
        else:
            rows.append([i, i])
        if chains and (i - chains[-1][1] == 1 or i - chains[-1][1] == 2 and len(tokens[i - 1]) <= FRAGMENT):
            chains[-1][1] = i
        else:
            chains.append([i, i])
    for first, last in {(a, b) for a, b in rows + chains}:
        before = first > 0 and len(tokens[first - 1]) <= FRAGMENT
        after = last + 1 < len(tokens) and len(tokens[last + 1]) <= FRAGMENT
        for start in {first, first - before}:
            for end in {last, last + after}:
                if end - start >= 2:
                    out.add(" ".join(tokens[start : end + 1]))
    return out


def restored(token: str, model: Characters) -> str:
    """A token in lower case as it was probably meant; one with a single reading stays."""
    word = token if " " in token else trimmed(token)
    if " " in word or needs_decoding(word):
        return viterbi(lattice(word), model)
    return word


def readings(token: str, model: Characters) -> set[str]:
    """Words of a token, as written and restored, of three letters or more."""
    word = trimmed(token)
    if word.isalpha() and " " not in token and not _RUN.search(word):
        return {word} if len(word) > 2 else set()
    return {w for w in (word, *restored(token, model).split()) if len(w) > 2}


def stems(word: str) -> list[str]:
    """A word and its heads; all begin with its first three letters."""
    return [word, *(f"{word[:n]}…" for n in (4, 5, 6) if len(word) > n)]


def features_of(token: str, model: Characters) -> list[str]:
    """Words of a token, as written and restored, and their heads, as stems."""
    return [f for word in readings(token, model) for f in stems(word)]


@dataclass
class Model:
    characters: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    shift: float = 0.0

    def probability(self, x: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.slope) * x + F.lit(self.shift))))


_FEATURE = pa.schema([("doc_id", pa.int64()), ("feature", pa.string())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("x", pa.float64())])


def _features(characters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = characters.tolist()
        cached = lru_cache(REMEMBERED)(lambda t: features_of(t, model))
        for part in slices(batches, "text", 1 << 20):
            ids, found = [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                own = {f for t in words_of(text) for f in cached(t)}
                ids.extend([doc] * len(own))
                found.extend(own)
            yield batch(_FEATURE, ids, found)

    return run


def _sums(characters: np.ndarray, weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        model, heads = characters.tolist(), {f[:3] for f in weights}

        def weight(token: str) -> float:
            """Of the heaviest feature; a word whose first letters no feature has is not looked up further."""
            return max((max(weights.get(f, 0.0) for f in stems(word)) if word[:3] in heads else 0.0 for word in readings(token, model)), default=0.0)

        for part in slices(batches, "text"):
            xs = []
            for text in part.column("text").to_pylist():
                if len(known) > REMEMBERED:
                    known.clear()
                found = words_of(text)
                new = found.difference(known)
                for t in new:
                    known[t] = weight(t)
                xs.append(min(10.0, math.fsum(map(known.__getitem__, found))))
            yield batch(_SCORED, part.column("doc_id"), xs)

    return run


def sums(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, x): weights of a text's distinct words, each by its heaviest feature, added up to 10."""
    return documents_of(documents).mapInArrow(_sums(model.characters, model.weights), "doc_id long, x double")


def fit(documents: DataFrame, labels: DataFrame, rows: int = 24_000, features: int = 20_000, evidence: float = 30.0) -> Model:
    """Learn from ``documents`` joined with ``labels`` (doc_id, label 0 or 1).

    The character model counts all documents. Bounds: at most ``rows`` labelled documents, drawn by a
    hash of the id, are used, two thirds for the weights and a third for the curve, and at most
    ``features`` features, those of most evidence, enter the model. A feature enters whose likelihood
    ratio reaches ``evidence`` and that label 1 favours. Without labels every score is one half.
    """
    model = Model(character_model(documents))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).filter("label IN (0, 1)").distinct()
    drawn = known.withColumn("order", F.xxhash64("doc_id", F.lit(8))).orderBy("order", "doc_id").limit(rows)
    drawn = stored(drawn.withColumn("part", F.pmod("order", F.lit(3))))
    docs = stored(documents_of(documents).join(F.broadcast(drawn), "doc_id"))  # at most ``rows`` rows
    learning, tuning = docs.filter("part <> 0"), docs.filter("part = 0")
    by_label = dict(learning.groupBy("label").count().collect())
    n0, n1 = by_label.get(0, 0), by_label.get(1, 0)
    if not n0 or not n1:
        found = dict(docs.groupBy("label").count().collect())
        model.shift = math.log((found.get(1, 0) + 0.5) / (found.get(0, 0) + 0.5))
        return model
    pairs = learning.mapInArrow(_features(model.characters), "doc_id long, feature string").join(F.broadcast(drawn.select("doc_id", "label")), "doc_id")
    counted = pairs.groupBy("feature").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b")).filter("a >= 3")
    p1, p0 = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    share = F.lit(n1 / (n0 + n1))
    total = F.col("a") + F.col("b")
    ratio = 2 * (F.col("a") * F.log(F.col("a") / (total * share)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (total * (1 - share)))).otherwise(0.0))
    chosen = counted.withColumn("weight", F.log(p1 / p0)).withColumn("ratio", ratio).filter((F.col("ratio") >= evidence) & (F.col("weight") > 1))
    model.weights = {r.feature: r.weight for r in chosen.orderBy(F.desc("ratio"), "feature").limit(features).select("feature", "weight").collect()}
    known_x = [(r.x, r.label) for r in sums(tuning, model).join(F.broadcast(drawn), "doc_id").select("x", "label").collect()]
    x, y = np.array([p[0] for p in known_x]), np.array([p[1] for p in known_x], float)
    if len(y) and y.min() < y.max():
        model.slope, model.shift = logistic(x, y)
    else:
        model.slope, model.shift = 1.0, math.log((n1 + 0.5) / (n0 + 0.5))
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row; null and empty texts have no word and get the least score."""
    out = sums(documents, model).select("doc_id", model.probability(F.col("x")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
