"""Quality rules whose cutoffs are certified on labelled holdouts.

For each stratum a half of the labelled documents proposes nested levels of cutoffs, from lenient to
strict. The other half, the holdout, tests the levels in that order with an exact binomial bound; the
last level before the first failure is used. Then, with the stated confidence over all strata
together (Bonferroni; a fixed sequence needs no further correction inside a stratum), no stratum
loses more than the stated share of its good documents to the cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientela.llm.shared import WORD, stored

SPACES = r"[\x20\x09-\x0D]"
METRICS = ("symbols", "capitals", "marks", "dup_lines", "repeats", "long_words", "short_words")
# share of the good proposal documents that each metric may reject at a level, per 100,000
LEVELS = (0, 50, 100, 200, 400, 800)
# cutoff that no metric exceeds
NO_CUTOFF = 1000
# strata whose cutoffs are sent to every task; beyond, they are joined by stratum
BROADCAST_STRATA = 10_000


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for all uses in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that the array has twice or more.

    Windows are sorted by the upper bits of their hash with the position in the lower bits.
    """

    def count(w: Column) -> Column:
        n = F.size(w)
        bits = F.ceil(F.log2(n.cast("double") + 1)).cast("int")

        def of_sorted(s: Column) -> Column:
            same = lambda i, j: F.call_function("shiftrightunsigned", F.get(s, i), bits_of) == F.call_function("shiftrightunsigned", F.get(s, j), bits_of)
            bits_of = F.ceil(F.log2((F.size(s) + 2).cast("double") + 1)).cast("int")
            low = F.call_function("shiftleft", F.lit(1).cast("long"), bits_of) - 1
            twice = F.filter(s, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            places = F.transform(twice, lambda x: x.bitwiseAND(low))
            return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))

        keys = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")))
        return F.when(n < 3, 0).otherwise(_let(F.sort_array(keys), of_sorted))

    return _let(words, count).cast("long")


def with_features(documents: DataFrame) -> DataFrame:
    """Add the counts of each text; columns of these names are replaced."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    words = F.filter(F.split(text, SPACES + "+"), lambda x: x != "")
    out = documents.withColumns({"_words": words, "_lines": lines})
    return out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACES))).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
            "n_marks": F.regexp_count(text, F.lit(r"[!?]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")),
        }
    ).drop("_words", "_lines")


def _share(part: str, whole: str, times: int = 1000) -> Column:
    """Whole thousandths, at most 1000; 0 of nothing."""
    value = F.expr(f"{part} * {times} div greatest({whole}, 1)")
    return F.least(value, F.lit(1000)).cast("int")


def _metrics() -> list[Column]:
    length = _share("word_chars", "n_words", 10)
    return [
        _share("n_symbols", "word_chars"),
        _share("n_capitals", "word_chars"),
        _share("n_marks", "word_chars"),
        _share("n_dup_lines", "n_lines"),
        _share("n_repeat_words", "n_words"),
        length,
        F.lit(1000) - length,
    ]


def binomial_tail(k: Column, n: Column, share: float) -> Column:
    """P(X <= k) for n trials of chance ``share``, summed term by term; 1 where k exceeds the mean."""
    first = F.struct((n * F.log1p(F.lit(-share))).alias("term"), F.exp(n * F.log1p(F.lit(-share))).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + F.log(F.lit(share / (1 - share)))
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    steps = F.when(k < 1, F.array().cast("array<long>")).otherwise(F.sequence(F.lit(1).cast("long"), F.least(k, F.ceil(n * share)).cast("long")))
    return F.when(k > n * share, 1.0).otherwise(F.aggregate(steps, first, step, lambda acc: acc["total"]))


def certified_cutoffs(features: DataFrame, labels: DataFrame, max_false: float, risk: float) -> DataFrame:
    """(stratum, level, cutoffs): of each stratum the strictest certified level; none: no row.

    ``features`` has doc_id, stratum and metrics of the documents that pass the fixed rules.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1)").distinct()
    rows = stored(features.join(known, "doc_id").withColumn("holdout", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1))
    good = F.col("quality") == 1
    fit = rows.filter("NOT holdout").select("stratum", "quality", F.posexplode("metrics").alias("metric", "value"))
    # rejected by the cutoff just below each value
    by_value = fit.groupBy("stratum", "metric", "value").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    falling = Window.partitionBy("stratum", "metric").orderBy(F.desc("value"))
    everything = Window.partitionBy("stratum", "metric")
    tails = by_value.select("stratum", "metric", (F.col("value") - 1).alias("cutoff"), F.sum("good").over(falling).alias("good"), F.sum("bad").over(falling).alias("bad"), F.sum("good").over(everything).alias("all_good"))
    allowed = tails.filter("bad > good").withColumn("level", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(x).alias("per")) for i, x in enumerate(LEVELS)])))
    allowed = allowed.filter("good * 100000 <= all_good * level.per")
    chosen = allowed.groupBy("stratum", F.col("level.level").alias("level"), "metric").agg(F.min("cutoff").alias("cutoff"))
    chosen = chosen.groupBy("stratum", "level").agg(F.map_from_entries(F.collect_list(F.struct("metric", "cutoff"))).alias("m"))
    cutoffs = stored(chosen.select("stratum", "level", F.array(*[F.coalesce(F.element_at("m", F.lit(i)), F.lit(NO_CUTOFF)) for i in range(len(METRICS))]).alias("cutoffs")))
    held = rows.filter("holdout AND quality = 1")
    totals = held.groupBy("stratum").agg(F.count("*").alias("n"))
    strata = totals.count()
    # every level of a stratum beside each other: at most as many as LEVELS
    ladder = cutoffs.groupBy("stratum").agg(F.collect_list(F.struct("level", "cutoffs")).alias("levels"))
    lost = held.join(_small(ladder), "stratum").select("stratum", F.explode(F.filter("levels", lambda x: exceeds(F.col("metrics"), x["cutoffs"]))["level"]).alias("level"))
    lost = lost.groupBy("stratum", "level").agg(F.count("*").alias("k"))
    tested = cutoffs.join(totals, "stratum").join(lost, ["stratum", "level"], "left").withColumn("k", F.coalesce("k", F.lit(0).cast("long")))
    tested = tested.withColumn("ok", binomial_tail(F.col("k"), F.col("n"), max_false) <= risk / max(strata, 1))
    order = Window.partitionBy("stratum").orderBy("level")
    passed = tested.withColumn("all_ok", F.min("ok").over(order)).filter("all_ok")
    return passed.groupBy("stratum").agg(F.max(F.struct("level", "cutoffs")).alias("best")).select("stratum", "best.level", "best.cutoffs")


def exceeds(metrics: Column, cutoffs: Column) -> Column:
    return F.exists(F.zip_with(metrics, cutoffs, lambda m, c: m > c), lambda x: x)


def _small(strata: DataFrame) -> DataFrame:
    """One row for each stratum, broadcast where there are few."""
    strata = stored(strata)
    return F.broadcast(strata) if strata.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA else strata


def judge(documents: DataFrame, labels: DataFrame, stratum: str = "lang", max_false: float = 0.02, risk: float = 0.05) -> DataFrame:
    """(doc_id, counts of the text, base_failed, kept) of every document.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated three-word
    windows. ``kept``: not so, and no metric above its stratum's certified cutoff. With confidence
    1 - ``risk`` the cutoffs reject at most ``max_false`` of the good documents of every stratum. A
    stratum with too few labels to certify anything keeps all that pass the base rules. A null stratum
    is one of its own; null and empty texts have no words and fail. Labels other than 0 and 1 and those
    of unknown documents are ignored. Repeated rows are judged alike; an empty table gives no rows.
    """
    own = documents.select("doc_id", "text", F.col(stratum).cast("string").alias("stratum")) if stratum in documents.columns else documents.select("doc_id", "text", F.lit("").alias("stratum"))
    own = own.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("stratum", F.lit("")).alias("stratum")).filter("doc_id IS NOT NULL")
    counts = with_features(own).drop("text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = stored(counts.withColumn("base_failed", failed).withColumn("metrics", F.array(*_metrics())))
    cutoffs = certified_cutoffs(counts.filter("NOT base_failed").select("doc_id", "stratum", "metrics"), labels, max_false, risk)
    out = counts.join(_small(cutoffs.select("stratum", "cutoffs")), "stratum", "left")
    kept = ~F.col("base_failed") & ~F.coalesce(exceeds(F.col("metrics"), F.col("cutoffs")), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
