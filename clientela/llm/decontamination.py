"""Benchmark decontamination by templates: numbers, units and names become typed slots, windows of
templates are joined by hash, and slots have to be filled consistently. So a question is found again
when its numbers and names were exchanged. Windows of plain lower-cased words find copies in any case, also
of items made mostly of numbers and names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.llm.shared import documents_of, stored
from clientela.operators.membership import SKETCHED_KEYS, key_sketch, perhaps_in

TOKEN = r"\p{N}+(?:[.,:/]\p{N}+)*|\p{Lu}[\p{L}\p{M}]*(?: \p{Lu}[\p{L}\p{M}]*)*|[\p{L}\p{M}]+"
NUMBER, UNIT, NAME = "0", "1", "2"
# fixed values: words that name a unit when they follow a number
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "gram", "grams", "ton", "tons", "pound", "pounds", "ounce", "ounces",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees",
]
# keeps hashes of plain windows apart from those of templates
PLAIN = 1
# benchmark windows sent to every task; beyond, windows are shuffled by hash, those that a sketch leaves
BROADCAST_WINDOWS = 500_000


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def words_of(tokens: Column) -> Column:
    """Single words in lower case: names are taken apart, numbers stay."""
    return F.split(F.lower(F.array_join(tokens, " ")), " ")


def template_of(tokens: Column) -> Column:
    """Each token as it stands, or the type of its slot."""

    def one(x: Column, i: Column) -> Column:
        unit = x.isin(UNITS) & F.coalesce(F.get(tokens, i - 1).rlike(r"^\p{N}"), F.lit(False))
        word = F.when(unit, UNIT).otherwise(x)
        # most tokens begin with a plain small letter and need no pattern
        return F.when((x >= "a") & (x < "{"), word).when(x.rlike(r"^\p{N}"), NUMBER).when(x.rlike(r"^\p{Lu}"), NAME).otherwise(word)

    return F.transform(tokens, one)


def with_windows(df: DataFrame, tokens: str, width: int, out: str, *salt: int) -> DataFrame:
    """Add ``out``: a hash of each ``width`` consecutive tokens.

    Every token is hashed once; hashes of pairs, of pairs of pairs and so on are then combined from two shifted
    arrays. Each step is a column of its own, so that none is computed twice.
    """
    columns, held, df = list(df.columns), 1, df.withColumn("_w1", F.transform(tokens, lambda x: F.xxhash64(x, *map(F.lit, salt))))
    combined: tuple[str, int] | None = None
    steps = width
    while True:
        if steps & 1:
            name = f"_w{held}"
            if combined is not None:
                df = df.withColumn("_c" + str(combined[1] + held), _behind(combined[0], name, combined[1]))
                name = "_c" + str(combined[1] + held)
            combined = (name, held + (combined[1] if combined else 0))
        steps >>= 1
        if not steps:
            break
        df = df.withColumn(f"_w{2 * held}", _behind(f"_w{held}", f"_w{held}", held))
        held *= 2
    count = F.greatest(F.size(tokens) - (width - 1), F.lit(0))
    return df.select(*columns, F.slice(combined[0], F.lit(1), count).alias(out))


def _behind(first: str, second: str, shift: int) -> Column:
    """A hash of each number of ``first`` and the number of ``second`` that lies ``shift`` behind."""
    return F.zip_with(first, F.slice(second, F.lit(shift + 1), F.size(second)), lambda a, b: F.xxhash64(a, b))


def contaminated(documents: DataFrame, benchmark: DataFrame, width: int = 8, share: float = 0.6, agree: float = 0.8, run: int = 13, long_run: int = 20) -> DataFrame:
    """(doc_id, item_id, matched, item_windows, slots, agreeing): documents that hold benchmark items.

    An item is held if ``share`` of its windows of ``width`` template tokens occur in the document, in
    alignments that fill at least ``agree`` of the item's distinct slot values with one value each; windows in
    which slots outnumber literal words are not indexed as templates. It is also held if ``share`` of its windows
    of ``width`` plain words (lower case, numbers kept, whatever their number) occur, or if ``run`` (``width`` at
    least) plain words of it in a row do, however long the item is; where ``share`` of the templates occurs but
    the slots contradict one another, it takes ``long_run`` words in a row. An item held by these alone has counts
    of plain windows and no slots. Items shorter than ``width`` are compared as a whole. Items without a letter
    or digit match nothing. Null and empty texts hold nothing; repeated rows count once; empty tables
    give no rows.
    """
    docs = documents_of(documents)
    items = benchmark.select("item_id", tokens_of(F.col("text").cast("string")).alias("tokens")).filter("item_id IS NOT NULL AND size(tokens) > 0")
    items = items.withColumn("words", words_of(F.col("tokens")))
    items = stored(items.withColumn("width", F.least(F.size("tokens"), F.lit(width))).withColumn("plain_width", F.least(F.size("words"), F.lit(width))).dropDuplicates())
    widths = sorted(r[0] for r in items.select(F.explode(F.array("width", "plain_width"))).distinct().collect())  # at most ``width`` values
    index = None
    for w in widths:
        part = items.filter(F.col("width") == w).select("item_id", template_of(F.col("tokens")).alias("t"))
        part = with_windows(part, "t", w, "h").select("item_id", "t", F.posexplode("h").alias("place", "h"))
        literal = F.size(F.filter(F.slice("t", F.col("place") + 1, w), lambda x: ~x.isin(NUMBER, UNIT, NAME)))
        part = part.filter(2 * literal >= w).select("item_id", "place", "h", F.lit(w).alias("w"), F.lit(False).alias("plain"))
        plain = with_windows(items.filter(F.col("plain_width") == w), "words", w, "h", PLAIN).select("item_id", F.posexplode("h").alias("place", "h"))
        part = part.union(plain.select("item_id", "place", "h", F.lit(w).alias("w"), F.lit(True).alias("plain")))
        index = part if index is None else index.union(part)
    empty = "doc_id long, item_id long, matched long, item_windows long, slots long, agreeing long"
    if index is None:
        return documents.sparkSession.createDataFrame([], empty)
    index = stored(index)
    totals = index.groupBy("item_id", "plain").agg(F.countDistinct("place").alias("item_windows"))
    rows = index.count()
    lookup = F.broadcast(index) if rows <= BROADCAST_WINDOWS else index
    sketch = stored(key_sketch(index, "h")) if BROADCAST_WINDOWS < rows <= SKETCHED_KEYS else None
    templates = docs.select("doc_id", tokens_of(F.col("text")).alias("tokens")).select("doc_id", template_of(F.col("tokens")).alias("t"), words_of(F.col("tokens")).alias("words"))
    found = None
    for w in widths:
        # both kinds in one pass over the texts: windows of templates, then of words
        both = with_windows(with_windows(templates, "t", w, "ht"), "words", w, "hw", PLAIN)
        windows = both.select("doc_id", F.size("ht").alias("n"), F.posexplode(F.concat("ht", "hw")).alias("at", "h"))
        if sketch is not None:  # most windows are in no item and are not shuffled
            windows = perhaps_in(windows, "h", sketch)
        part = windows.join(lookup.filter(F.col("w") == w), "h").withColumn("at", F.col("at") - F.when(F.col("plain"), F.col("n")).otherwise(0))
        part = part.select("doc_id", "at", "item_id", "place", "w", "plain")
        found = part if found is None else found.union(part)
    found = stored(found.distinct().withColumn("shift", F.col("at") - F.col("place")))
    enough = F.col("matched") >= share * F.col("item_windows")
    counted = found.groupBy("doc_id", "item_id", "plain").agg(F.countDistinct("place").alias("matched")).join(totals, ["item_id", "plain"])
    # a run of words is a run of windows in one alignment, which holds at most the places of the item
    places = found.filter(F.col("plain") & (F.col("w") == width)).groupBy("doc_id", "item_id", "shift").agg(F.sort_array(F.collect_set("place")).alias("places"))

    def in_a_row(words: int) -> Column:
        more = max(words - width, 0)
        return F.exists(F.transform("places", lambda place, i: F.coalesce(F.get("places", i + more) == place + more, F.lit(False))), lambda x: x)

    runs = places.filter(in_a_row(run)).groupBy("doc_id", "item_id").agg(F.max(in_a_row(long_run)).alias("long"))
    copies = counted.filter("plain").join(runs, ["doc_id", "item_id"], "left").filter(enough | F.col("long").isNotNull())
    copies = copies.select("doc_id", "item_id", "matched", "item_windows", (enough | F.col("long")).alias("sure"))
    likely, totals = counted.filter(enough & ~F.col("plain")).select("doc_id", "item_id"), totals.filter("NOT plain").drop("plain")
    found = stored(found.filter("NOT plain").join(likely, ["doc_id", "item_id"], "left_semi"))
    # a table of ids alone is small enough to be sent to the texts longer than the windows are
    texts = docs.join(stored(found.select("doc_id").distinct()), "doc_id", "left_semi").dropDuplicates().select("doc_id", tokens_of(F.col("text")).alias("doc_tokens"))
    aligned = found.join(texts, "doc_id").join(items.select("item_id", "tokens"), "item_id")
    pairs = F.zip_with(F.slice("tokens", F.col("place") + 1, F.col("w")), F.slice("doc_tokens", F.col("at") + 1, F.col("w")), lambda a, b: F.struct(a.alias("item_value"), b.alias("doc_value")))
    slots = F.filter(pairs, lambda p: p["item_value"].rlike(r"^[\p{N}\p{Lu}]"))
    filled = aligned.select("doc_id", "item_id", "shift", F.explode(slots).alias("p")).select("doc_id", "item_id", "shift", "p.*")
    filled = filled.groupBy("doc_id", "item_id", "shift", "item_value").agg((F.min("doc_value") == F.max("doc_value")).cast("long").alias("one"))
    filled = filled.groupBy("doc_id", "item_id", "shift").agg(F.count("*").alias("slots"), F.sum("one").alias("agreeing"))
    kept = found.join(filled, ["doc_id", "item_id", "shift"], "left").filter(F.coalesce(F.col("agreeing") >= agree * F.col("slots"), F.lit(True)))
    out = kept.groupBy("doc_id", "item_id").agg(
        F.countDistinct("place").alias("matched"), F.coalesce(F.max("slots"), F.lit(0).cast("long")).alias("slots"), F.coalesce(F.max("agreeing"), F.lit(0).cast("long")).alias("agreeing")
    )
    out = stored(out.join(totals, "item_id").filter(enough).select("doc_id", "item_id", "matched", "item_windows", "slots", "agreeing"))
    none = F.lit(0).cast("long")
    unsure = copies.filter("NOT sure").join(likely, ["doc_id", "item_id"], "left_anti")
    copies = copies.filter("sure").union(unsure).join(out, ["doc_id", "item_id"], "left_anti").withColumn("slots", none).withColumn("agreeing", none)
    return out.union(copies.select(out.columns))
