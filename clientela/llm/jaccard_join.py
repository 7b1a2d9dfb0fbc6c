"""N-gram Jaccard join by universe partition and pigeonhole.

Sets of word shingles are compared by size band. The hash universe is cut into segments; two sets
of the required similarity differ in a bounded number of elements, so that some segment differs in
none of them (whole subset indexed) or in at most one (subset and its one-deletion neighbourhood
indexed). Which of the two, and how many segments, is settled per size band by cost, with the chance
of false agreement measured on a sample. Shared
signatures give candidates, and every candidate that could join two classes is verified on the sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientela.llm.components import components
from clientela.llm.shared import documents_of, narrowed, release, removed, slices, stored
from clientela.llm.words import batch, mix, sets_of, signed, texts_of

# chance that two unrelated sets agree on one element of a segment, where no sample says
_AGREE = 0.1
# cost of a false candidate, a look at two sketches, in signatures written and sorted
_CHECK_COST = 0.5
# sets of a band, about, and signatures of each that its agreement is measured on; least elements that tell copies
_SAMPLED, _SIGNATURES, _MINIMA = 128, 64, 4
# signatures of a deletion index: so many, or so many for each element, at most. Sixteen bytes each would otherwise
# outweigh the texts
_DELETIONS, _DELETIONS_PER_ELEMENT = 64, 0.5


@dataclass(frozen=True)
class Band:
    """Sets of sizes ``low`` to ``high`` with partners of up to ``high / threshold``.

    With ``deletions`` a segment may differ by one element, so half as many segments suffice.
    Without, ``spare`` segments more than needed exist: a set may leave out up to so many empty ones.
    """

    low: int
    high: int
    segments: int
    deletions: bool
    spare: int


def plan_bands(largest: int, threshold: Fraction, sizes: dict[int, int], agree: dict[int, float] | None = None) -> list[Band]:
    """Bands up to ``largest``.

    ``sizes`` has the number of sets by band, ``agree`` the measured chance that unrelated sets of a band agree on a whole
    segment. They steer the allocation: deletions double the elements of a segment, which squares that chance, at
    the price of a signature for each element.
    """
    bands, low = [], 1
    while low <= largest:
        high = int(low / threshold)
        differ = math.floor((1 - threshold) / (1 + threshold) * (high + math.floor(high / threshold)))
        spare = 0
        for _ in range(8):  # more segments are emptier
            load = low / (differ + 1 + spare)
            spare = math.ceil((differ + 1 + spare) * math.exp(-load) * 1.5) if load > 1 else 0
        whole, halves = differ + 1 + spare, (differ + 2) // 2
        n = sizes.get(len(bands), 0) + sizes.get(len(bands) + 1, 0)
        chance = (agree or {}).get(len(bands), _AGREE ** (high / whole))
        whole_cost = whole * (1 + _CHECK_COST * n * chance)
        halves_cost = halves + high + halves * _CHECK_COST * n * chance ** (whole / halves)
        deletions = halves_cost < whole_cost and halves + high <= max(_DELETIONS, _DELETIONS_PER_ELEMENT * low)
        bands.append(Band(low, high, halves if deletions else whole, deletions, 0 if deletions else spare))
        low = high + 1
    return bands


def signatures_of(elements: np.ndarray, index: int, band: Band) -> np.ndarray:
    """Signatures of one set in the band's index."""
    salt = mix(np.array([index + 1], np.uint64) * np.uint64(0xD1B54A32D192ED03))[0]
    keys = mix(elements ^ salt)
    segment = (((keys >> np.uint64(32)) * np.uint64(band.segments)) >> np.uint64(32)).astype(np.int64)
    values = mix(keys + np.uint64(1))
    order = np.argsort(segment, kind="stable")
    cuts = np.searchsorted(segment[order], np.arange(band.segments + 1))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values[order], out=sums[1:])
    whole = sums[cuts[1:]] - sums[cuts[:-1]]
    place = np.arange(band.segments, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt
    if band.deletions:
        less = whole[segment] - values
        return np.unique(mix(np.concatenate((whole ^ place, less ^ place[segment]))))
    empty = cuts[1:] == cuts[:-1]
    if empty.sum() <= band.spare:  # what agrees with a partner beyond the empty ones is enough
        return mix((whole ^ place)[~empty])
    return mix(whole ^ place)


# numbers of 64 bits in a sketch; cells of a wide one for each element that a linked pair may differ in, at least
SKETCH, _CELLS = 8, 3
_LONGS = ["n_shingles", "k1", "k2", *[f"s{i}" for i in range(SKETCH)]]
_MEMBER = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in _LONGS], ("wide", pa.binary())])
_MEMBER_DDL = "doc_id long, " + ", ".join(f"{c} long" for c in _LONGS) + ", wide binary"
_SIGNATURE = pa.schema([("sig", pa.int64()), ("doc_id", pa.int64())])
_SET = pa.schema([("doc_id", pa.int64()), ("elements", pa.binary())])


def _members(width: int, limit: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sizes, keys, marks, wide = [], [], [], []
            for s in sets_of(texts_of(part.column("text")), width):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                words = words_of(len(s), limit)
                sketch = sketch_of(s, words)
                marks.append(folded(sketch, SKETCH))
                wide.append(sketch.tobytes() if words > SKETCH else None)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield batch(_MEMBER, part.column("doc_id"), sizes, *k.T, *np.array(marks).view(np.int64).T, wide)

    return run


def _signatures(width: int, bands: list[Band]):
    lows = np.array([b.low for b in bands])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in slices(batches, "text"):
            sigs, owners = [], []
            for doc, s in zip(part.column("doc_id").to_pylist(), sets_of(texts_of(part.column("text")), width)):
                if not len(s):
                    continue
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if key in seen:  # a copy in the same task: its twin stands for it
                    continue
                if len(seen) >= 100_000:
                    seen.clear()
                seen.add(key)
                own = int(np.searchsorted(lows, len(s), "right")) - 1
                for g in (own - 1, own):
                    if g >= 0:
                        sigs.append(signatures_of(s, g, bands[g]))
                        owners.append(np.full(len(sigs[-1]), doc, np.int64))
            if sigs:
                yield batch(_SIGNATURE, signed(np.concatenate(sigs)), np.concatenate(owners))

    return run


_SAMPLE = pa.schema([("band", pa.int32()), ("least", pa.binary()), ("sigs", pa.binary())])


def _sample(width: int, bands: list[Band]):
    """Least elements, and some signatures without deletions, of sets in each band that their size puts them in."""
    lows = np.array([b.low for b in bands])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for s in sets_of(texts_of(part.column("text")), width):
                if not len(s):
                    continue
                g = int(np.searchsorted(lows, len(s), "right")) - 1
                sigs = signatures_of(s, g, replace(bands[g], deletions=False, spare=bands[g].segments))
                # the same choice for every set, so that what agrees is chosen together
                kept = sigs[sigs % np.uint64(-(-bands[g].segments // _SIGNATURES)) == 0]
                rows.append((g, s[:_MINIMA].tobytes(), kept.tobytes()))
            if rows:
                yield batch(_SAMPLE, *zip(*rows))

    return run


def agreement(rows: list[tuple[int, bytes, bytes]], bands: list[Band]) -> dict[int, float]:
    """By band, the chance that two unrelated sets of the sample agree on a segment; one more agreement is assumed.

    Sets that share one of their least elements with a set before, as near copies do, are left out.
    """
    chances = {}
    for band in {g for g, _, _ in rows}:
        taken: set[bytes] = set()
        sigs = []
        for _, least, found in (r for r in rows if r[0] == band):
            minima = {least[i : i + 8] for i in range(0, len(least), 8)}
            if not minima & taken:
                sigs.append(np.frombuffer(found, np.uint64))
            taken |= minima
        pairs = len(sigs) * (len(sigs) - 1) / 2
        segments = sum(map(len, sigs)) / max(1, len(sigs))
        if pairs >= 100 and segments >= 1:
            times = np.unique(np.concatenate(sigs), return_counts=True)[1].astype(float)
            chances[band] = min(1.0, (1 + (times * (times - 1) / 2).sum()) / (pairs * segments))
    return chances


def _measured(docs: DataFrame, members: DataFrame, width: int, threshold: Fraction, largest: int, sizes: dict[int, int]) -> dict[int, float]:
    """:func:`agreement` of about ``_SAMPLED`` different sets of each band, chosen by a hash of the set."""
    bands = plan_bands(largest, threshold, {})
    one_in = F.lit(1)
    for g, band in enumerate(bands):
        one_in = F.when(F.col("n_shingles") >= band.low, max(1, sizes.get(g, 0) // _SAMPLED)).otherwise(one_in) if g else F.lit(max(1, sizes.get(0, 0) // _SAMPLED))
    drawn = members.filter("n_shingles > 0").filter(F.pmod(F.xxhash64("k1", "k2"), one_in) == 0).groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    found = docs.join(F.broadcast(stored(drawn.select("doc_id").distinct())), "doc_id", "left_semi").mapInArrow(_sample(width, bands), "band int, least binary, sigs binary")
    # bounded by the number of bands, which is the logarithm of the largest set
    return agreement([tuple(r) for r in found.collect()], bands)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield batch(_SET, part.column("doc_id"), [s.tobytes() for s in sets_of(texts_of(part.column("text")), width)])

    return run


def sketch_of(elements: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Parities of the numbers of elements in ``64 * words`` cells.

    Each element that one of two sets has alone changes one bit: they differ in as many elements, at
    least, as their sketches in bits.
    """
    cells = np.bincount((mix(elements) >> np.uint64(32)).astype(np.int64) % (64 * words), minlength=64 * words)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.uint64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set in ``words`` numbers, its own times a power of two."""
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def words_of(size: int, limit: Fraction) -> int:
    """Numbers in the sketch of a set. Unrelated sets differ in half of the cells at most: with too few, nothing is ruled out."""
    words, differ = SKETCH, 2 * size * (limit.denominator - limit.numerator) // (limit.denominator + limit.numerator)
    while 64 * words < _CELLS * differ:
        words *= 2
    return words


def _may_link(limit: Fraction) -> str:
    """Condition on sizes and sketches of two sets that every linked pair fulfils."""
    top, low = limit.numerator, limit.denominator
    bits = " + ".join(f"bit_count(s{i} ^ o{i})" for i in range(SKETCH))
    return f"{low} * least(size, other_size) >= {top} * greatest(size, other_size) AND {low + top} * ({bits}) <= {low - top} * (size + other_size)"


def _may_link_widely(limit: Fraction):
    """Pairs but those of which both sets have a wide sketch, and these rule a link out."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    top, low = limit.numerator, limit.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            kept = []
            for n, a, b in zip(part.column("sizes").to_pylist(), part.column("a"), part.column("b")):
                if not (a.is_valid and b.is_valid):
                    kept.append(True)
                    continue
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                words = min(len(x), len(y))
                bits = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                kept.append((low + top) * bits <= (low - top) * n)
            yield batch(schema, part.column("u"), part.column("v")).filter(pa.array(kept, pa.bool_()))

    return run


def _verify(threshold: Fraction):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("linked", pa.bool_())])
    top, low = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            linked = []
            for a, b in zip(part.column("a"), part.column("b")):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(low * both >= top * (len(x) + len(y) - both))
            yield batch(schema, part.column("u"), part.column("v"), linked)

    return run


def _cross(members: DataFrame) -> DataFrame:
    """Members of the signatures that still span several classes."""
    spans = members.groupBy("sig").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b")
    return members.join(spans.select("sig"), "sig", "left_semi")


def _crowds(members: DataFrame) -> DataFrame:
    """(sig, doc_id, class): members of signatures with the same least class as one group, in which each pair stands once.

    Texts that share many signatures would be looked at once for each. Where the group has more pairs across classes
    than its signatures together, as about a text that shares one with each of many others, these stay as they are.
    """

    def across(rows: DataFrame, key: str, *more) -> DataFrame:
        sizes = rows.groupBy(key, "class").agg(F.count("*").cast("double").alias("n"))
        return sizes.groupBy(key).agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"), *more)

    spans = stored(across(members, "sig", F.min("class").alias("crowd")))
    named = stored(members.join(spans.select("sig", "crowd"), "sig"))
    once = named.select("crowd", "doc_id", "class").distinct()
    apart = spans.groupBy("crowd").agg(F.sum("pairs").alias("apart"))
    fewer = stored(across(once, "crowd").join(apart, "crowd").filter("pairs < apart").select("crowd"))
    rest = named.join(fewer, "crowd", "left_anti").select("sig", "doc_id", "class")
    # a crowd's number may be a signature as well: that adds pairs and loses none
    out = stored(once.join(fewer, "crowd", "left_semi").select(F.col("crowd").alias("sig"), "doc_id", "class").union(rest))
    removed(spans, named, fewer)
    return out


def _pairs_and_rows(members: DataFrame) -> tuple[float, int]:
    """Pairs across classes that share a signature, for each that they share, and rows."""
    size = members.groupBy("sig", "class").count().groupBy("sig").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("same"))
    return size.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.sum("n")).first()


def jaccard_classes(documents: DataFrame, width: int = 5, threshold: str = "0.8", chain_rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id): classes of documents linked at ``threshold`` or more.

    Documents are linked if the Jaccard similarity of their sets of ``width``-word shingles reaches
    ``threshold`` (a decimal in text, compared exactly). Null and empty texts have no shingle, link
    with nothing and are their own class; fewer words than ``width`` are one shingle. Rows that repeat
    come out as often; those of one ``doc_id`` with different texts are taken as separate sets of the
    same document. Other columns are ignored, an empty table gives no rows.

    Equal sets are one set for the join. Sets that share a signature are compared along chains over
    random orders, ``chain_rounds`` times or until few pairs across classes are left; then all of
    those are looked at, once for many shared signatures, and compared where sizes and sketches do not rule a link out. So no link
    between classes is missed, and a large group of near copies costs a few comparisons each, not all pairs.
    """
    limit, spark = Fraction(threshold), documents.sparkSession
    docs = documents_of(documents)
    members = stored(docs.mapInArrow(_members(width, limit), _MEMBER_DDL))
    lows, low, largest = [], 1, members.agg(F.max("n_shingles")).first()[0] or 0
    while low <= largest:
        lows.append(low)
        low = int(low / limit) + 1
    if not lows:
        return members.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    # one row for each band comes back: their number is the logarithm of the largest set
    index = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(1 / limit)).cast("int")
    by_log = members.filter("n_shingles > 0").groupBy("n_shingles").count()
    by_log = by_log.groupBy(index.alias("i")).agg(F.sum("count"), F.min("n_shingles")).collect()
    sizes: dict[int, int] = {}
    for _, n, least in by_log:
        k = int(np.searchsorted(lows, least, "right")) - 1
        sizes[k] = sizes.get(k, 0) + n
    bands = plan_bands(largest, limit, sizes, _measured(docs, members, width, limit, largest, sizes))

    copies = members.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("twin"))
    standing = stored(copies.select(F.col("twin").alias("doc_id")).distinct())  # other copies' signatures would be shuffled in vain
    sigs = narrowed(docs, standing, "doc_id").mapInArrow(_signatures(width, bands), "sig long, doc_id long")
    order = Window.partitionBy("sig").orderBy("doc_id")
    first = stored(
        sigs.withColumn("before", F.lag("doc_id").over(order))
        .withColumn("after", F.lead("doc_id").over(order))
        .filter("before <> doc_id OR after <> doc_id")
        .select("sig", "doc_id")
    )
    release(spark)  # the signatures that no other set has
    twins = stored(members.filter("n_shingles > 0").join(copies, ["k1", "k2"]).select("doc_id", "twin").distinct())
    # a document id whose rows have several sets has a twin for each
    shared = first.join(twins, "doc_id").select("sig", F.col("twin").alias("doc_id")).distinct()
    crowd = Window.partitionBy("sig")
    shared = stored(shared.withColumn("n", F.count("*").over(crowd)).filter("n > 1").select("sig", "doc_id"))
    wanted = stored(shared.select("doc_id").distinct())
    marks = ["size", *[f"s{i}" for i in range(SKETCH)]]
    others = ["other_size", *[f"o{i}" for i in range(SKETCH)]]
    # of rows that repeat one; an id may have several sets
    looks = stored(members.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "k1", "k2"]).withColumnRenamed("n_shingles", "size").select("doc_id", *marks, "wide"))
    sketches = looks.select("doc_id", *marks)
    removed(standing, first, twins, wanted)
    release(spark)

    classes, links, checked, judgements = None, None, None, []
    for turn in range(chain_rounds + 1):
        if classes is None:
            named = shared.withColumn("class", F.col("doc_id"))
        else:
            named = shared.join(classes, F.col("doc_id") == F.col("node"), "left")
            named = stored(_cross(named.select("sig", "doc_id", F.coalesce("component", "doc_id").alias("class"))))
        left, rows = _pairs_and_rows(named)
        last = turn == chain_rounds or not left or left <= 2 * rows
        if left:
            crowds = _crowds(named) if last else None
            few = True
            if last:
                together, rows = _pairs_and_rows(crowds)
                few = together <= rows
            if not few:  # a look at the sketches inside the join, as the pairs may be too many for rows of their own
                marked = crowds.join(sketches, "doc_id")
                other = marked.select("sig", F.col("doc_id").alias("w"), F.col("class").alias("other"), *[F.col(a).alias(b) for a, b in zip(marks, others)])
                pairs = marked.join(other, "sig").filter("class < other").filter(_may_link(limit)).select("doc_id", "w")
            elif last:
                other = crowds.select("sig", F.col("doc_id").alias("w"), F.col("class").alias("other"))
                pairs = crowds.join(other, "sig").filter("class < other").select("doc_id", "w")
            else:
                chain = Window.partitionBy("sig").orderBy(F.xxhash64("doc_id", F.lit(turn)), "doc_id")
                pairs = named.withColumn("w", F.lead("doc_id").over(chain)).withColumn("other", F.lead("class").over(chain))
                pairs = pairs.filter("class <> other").select("doc_id", "w")
            pairs = pairs.select(F.least("doc_id", "w").alias("u"), F.greatest("doc_id", "w").alias("v")).distinct()
            if checked is not None:
                pairs = pairs.join(checked, ["u", "v"], "left_anti")
            if few:
                pairs = pairs.join(sketches.withColumnRenamed("doc_id", "u"), "u")
                pairs = pairs.join(sketches.select(F.col("doc_id").alias("v"), *[F.col(a).alias(b) for a, b in zip(marks, others)]), "v")
                pairs = pairs.filter(_may_link(limit)).select("u", "v")
            # in long sets the sketches above rule nothing out, and pairs of these grow with the square of the rows
            for side, name in (("u", "a"), ("v", "b")):
                pairs = pairs.join(looks.select(F.col("doc_id").alias(side), F.col("size").alias(f"size_{name}"), F.col("wide").alias(name)), side)
            pairs = pairs.select("u", "v", (F.col("size_a") + F.col("size_b")).alias("sizes"), "a", "b")
            pairs = stored(pairs.mapInArrow(_may_link_widely(limit), "u long, v long"))
            asked = stored(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
            release(spark)
            # elements outweigh the texts: only those of sets that are compared now
            sets = stored(narrowed(docs, asked, "doc_id").join(asked, "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, elements binary"))
            with_a = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("elements").alias("a")), "u")
            with_b = with_a.join(sets.select(F.col("doc_id").alias("v"), F.col("elements").alias("b")), "v")
            judged = stored(with_b.mapInArrow(_verify(limit), "u long, v long, linked boolean"))
            judgements.append(judged)
            found = judged.filter("linked").select("u", "v")
            links = found if links is None else links.union(found)
            checked = judged.select("u", "v") if checked is None else checked.union(judged.select("u", "v"))
            before, classes = classes, stored(components(links))
            removed(pairs, asked, sets, *(table for table in (before, crowds) if table is not None))
        if turn:
            removed(named)
        release(spark)
        if last:
            break
    removed(shared, looks, *judgements)
    out = members.join(copies, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.coalesce("twin", "doc_id").alias("twin"))
    if classes is not None:
        out = out.join(classes, F.col("twin") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "twin").alias("twin"))
    return out.withColumnRenamed("twin", "component_id")
