"""Keeping rows whose key is in a long list, without shuffling the rows that it leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# bits of the sketch of a key list: at most BITS / 64 rows of two longs, so it may always be broadcast
BITS = 1 << 26
# a longer list would fill so much of the sketch that it rules little out
SKETCHED_KEYS = BITS // 4


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(BITS))


def key_sketch(keys: DataFrame, key: str) -> DataFrame:
    """A Bloom filter of one hash as (word, bits): bit ``h % 64`` of word ``h div 64`` for every key's hash h."""
    place = _place(key)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    return keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def surely_out(rows: DataFrame, key: str, sketch: DataFrame) -> DataFrame:
    """The rows that :func:`perhaps_in` leaves out: none of them has a key in the list, all without a key are here."""
    place = _place(key)
    looked_up = F.broadcast(sketch.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    found = rows.join(looked_up, F.col(key).isNotNull() & (F.shiftright(place, 6) == F.col("_word")), "left")
    return found.filter(F.coalesce(F.getbit("_bits", (place % 64).cast("int")), F.lit(0)) == 0).select(*rows.columns)


def perhaps_in(rows: DataFrame, key: str, sketch: DataFrame) -> DataFrame:
    """Rows whose key may be in the list of ``sketch``: all that are in it, and few others."""
    place = _place(key)
    looked_up = F.broadcast(sketch.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    found = rows.join(looked_up, F.col(key).isNotNull() & (F.shiftright(place, 6) == F.col("_word")))
    return found.filter(F.getbit("_bits", (place % 64).cast("int")) == 1).select(*rows.columns)
