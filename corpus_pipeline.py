"""A corpus pipeline over ``documents``: rules, near duplicates, repeated passages, benchmark items, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each but the last
returns the columns of ``documents``. Documents are told apart by ``doc_id``: rows without one are left
out, and of rows that repeat one the least, column by column, stands in the first two stages, whatever the order
of rows. Null texts are empty texts. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientela.llm import byte_bpe
from clientela.llm.decontamination import contaminated
from clientela.llm.jaccard_join import jaccard_classes
from clientela.llm.quality_rules import judge
from clientela.llm.shared import release, ship, stored, without
from clientela.llm.substring_dedup import remove_repeats


def one_row_an_id(docs: DataFrame) -> DataFrame:
    """The least row of each id; copies of an id are reduced where they are before they meet."""
    known = docs.filter("doc_id IS NOT NULL")
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return known
    rest = [c for c in docs.columns if c != "doc_id"]
    least = known.groupBy("doc_id").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("_row"))
    return least.select(*(F.col("doc_id") if c == "doc_id" else F.col(f"_row.`{c}`") for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    docs = one_row_an_id(docs)
    kept = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept").select("doc_id")
    return docs.join(kept.distinct(), "doc_id", "left_semi").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class linked by a similarity of 0.8 on five-word shingles."""
    ship(spark)
    docs = one_row_an_id(docs)
    copies = stored(jaccard_classes(docs, width=5, threshold="0.8").filter("doc_id <> component_id").select("doc_id"))
    release(spark)
    return without(docs, copies, "doc_id")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without 50-word passages of smaller ids; those of which no word is left go."""
    ship(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = remove_repeats(docs, width=50, rest=others).filter("n_removed = 0 OR n_removed < n_words")
    out = out.withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", "n_chars", *[F.col(f"rest.{c}").alias(c) for c in others])
    return out.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = stored(contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct())
    release(spark)
    return without(docs, found, "doc_id")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): token ids, and proof that they decode."""
    ship(spark)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digests(byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]
# stages in Python and certified cutoffs over what others removed: held against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the table of documents; what each keeps is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
