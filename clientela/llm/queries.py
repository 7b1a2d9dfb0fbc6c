"""The operators as queries over the given tables, under the result contracts they have to meet."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientela.llm import byte_bpe, compression_quality, toxicity
from clientela.llm.decontamination import contaminated
from clientela.llm.exact_top_k import exact_top_k
from clientela.llm.filter_audit import failures, interactions, labelled
from clientela.llm.hard_negatives import hard_negatives
from clientela.llm.html_extraction import extract
from clientela.llm.jaccard_join import jaccard_classes
from clientela.llm.katz import katz_scores
from clientela.llm.oracle import ORACLE
from clientela.llm.quality_rules import SPACES, judge
from clientela.llm.shared import fold, ship
from clientela.llm.substring_dedup import remove_repeats
from clientela.llm.url_filter import judge_urls
from clientela.llm.vectors import integer_vectors

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of documents whose sets of three-word shingles have a similarity of 0.9 or more."""
    return jaccard_classes(table(spark, folder, "documents"), width=3, threshold="0.9")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page under the contract's rules and its redirect class."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, folder, "pages"), rules)


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of each document, with cutoffs certified for each language."""
    return judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Katz log probability of each document, learnt from four folds of five."""
    docs = table(spark, folder, "documents")
    return katz_scores(docs, fold(5) == 1)


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of each document by compression, learnt from the labels of two folds of three."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    known = labels.filter(fold(3) != 1).select("doc_id", F.col("quality").alias("label"))
    out = compression_quality.score(docs, compression_quality.fit(docs, known))
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op6_byte_bpe(spark: SparkSession, folder: str, ranks: str | None = None) -> DataFrame:
    """Ids of each document and the bytes they decode to, as digests."""
    content = byte_bpe.read_ranks(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digests(byte_bpe.round_trip(table(spark, folder, "documents"), content, public_tokenizers.PATTERN))


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    out = extract(table(spark, folder, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of each document by its restored words, learnt from the labels of four folds of five."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    known = labels.filter(fold(5) != 0).select("doc_id", F.col("toxic").alias("label"))
    out = toxicity.score(docs, toxicity.fit(docs, known))
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words left of each document without 50-word passages of smaller ids, as a digest."""
    out = remove_repeats(table(spark, folder, "documents"), width=50)
    words = F.trim(F.regexp_replace("text", SPACES + "+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode(words, "UTF-8"), 256).alias("kept_sha256"))


def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold benchmark items, word for word or with other numbers and names."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters removes at every step of all 120 orders, for each source."""
    failed = failures(table(spark, folder, "documents"), F.col("source"))
    known = labelled(failed, table(spark, folder, "labels"), good=F.col("quality") == 1, toxic=F.col("toxic") == 1)
    return interactions(known, "ABCDE", ("good", "toxic"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Near rows of another label within each positive's window of scores, labels of one id in seven changed."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = integer_vectors(table(spark, folder, "embeddings"), 256, vec_id=F.col("vec_id").cast("long"), label=label.cast("long"), vector=F.col("embedding"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op13_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five rows of highest inner product with every row whose id is divisible by 50."""
    vectors = integer_vectors(table(spark, folder, "embeddings"), 256, vec_id=F.col("vec_id").cast("long"), vector=F.col("embedding"))
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_url_filters": op2_url_filters,
    "op3_quality_rules": op3_quality_rules,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_html_extraction": op7_html_extraction,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_filter_audit": op11_filter_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_exact_top_k": op13_exact_top_k,
}
__all__ = ["ORACLE", "QUERIES"]
