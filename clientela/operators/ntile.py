"""``ntile`` over a whole table, without sending the table to one task."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from clientela.operators.durable import durable

_PARTITION_BITS = 33  # monotonically_increasing_id() is partition << 33 | position


def descending(column: Column) -> list[Column]:
    """Sort key for a number from high to low, missing ones last."""
    return [column.isNull(), -column]


def add_tiles(df: DataFrame, keys: dict[str, list[Column]], tiles: int) -> DataFrame:
    """Add one tile column (1..tiles) per entry of ``keys``, each a list of ascending sort keys.

    The keys of an entry have to be unique together, so that tiles do not depend on chance.
    ``df`` should be cheap to read (see :func:`durable`). All entries are ranked together, by three
    actions whatever their number. Only the first key of each tile is looked up, and a row's tile is the
    number of such keys it does not precede.
    """
    columns = {}
    for name, firsts in first_keys(df, keys, tiles).items():
        tile = F.lit(1)
        for first in firsts:
            tile = tile + (F.struct(*keys[name]) >= first).cast("int")
        columns[name] = tile
    return df.withColumns(columns)


def first_keys(df: DataFrame, keys: dict[str, list[Column]], tiles: int) -> dict[str, list[Column]]:
    """For each entry of ``keys`` the smallest key of each tile but the first, as literals.

    The keys of all entries become one long table, a row for each row of ``df`` and entry with the
    entry's number in front, that is range-partitioned and sorted once; many rows with the same metric
    still spread, because the rest of the key tells them apart. The position of a key is its position
    within the partition plus the entry's rows in all partitions before, so one count by entry and
    partition says where each tile starts. The numbered keys are written first: computed a second time,
    range bounds could be drawn differently.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = {name: [f"k{e}_{i}" for i in range(len(key))] for e, (name, key) in enumerate(keys.items())}
    names = [n for own in parts.values() for n in own]
    kinds = df.select(*(k.alias(n) for own, key in zip(parts.values(), keys.values()) for n, k in zip(own, key))).schema

    def entry(number: int, name: str) -> Column:
        """The entry's keys, and nothing in the columns of the others."""
        own = dict(zip(parts[name], keys[name]))
        given = (own[f.name] if f.name in own else F.lit(None).cast(f.dataType) for f in kinds)
        return F.struct(F.lit(number).alias("entry"), *(c.alias(f.name) for c, f in zip(given, kinds)))

    long = df.select(F.inline(F.array(*(entry(e, name) for e, name in enumerate(keys)))))
    numbered = durable(
        long.repartitionByRange(partitions, "entry", *names)
        .sortWithinPartitions("entry", *names)
        .withColumn("id", F.monotonically_increasing_id())
    )
    # at most one row per entry and partition reaches the driver, whatever the data
    part = F.shiftright("id", _PARTITION_BITS)
    sizes = numbered.groupBy("entry", part.alias("part")).agg(F.min("id").alias("first"), F.count("*").alias("rows")).collect()

    wanted: dict[int, int] = {}  # number of a row: the entry that it belongs to
    for e in range(len(keys)):
        here = sorted((row["first"], row["rows"]) for row in sizes if row["entry"] == e)
        starts = [0, *accumulate(rows for _, rows in here)]
        size, larger = divmod(starts[-1], tiles)  # the first `larger` tiles hold one row more
        for tile in range(1, tiles):
            position = tile * size + min(tile, larger)
            if position < starts[-1]:
                at = bisect_right(starts, position) - 1
                wanted[here[at][0] + position - starts[at]] = e
    found = numbered.filter(F.col("id").isin(list(wanted))).orderBy("id").collect() if wanted else []
    of_entry = {name: [r for r in found if wanted[r["id"]] == e] for e, name in enumerate(keys)}
    return {name: [_literal(row, numbered, parts[name]) for row in rows] for name, rows in of_entry.items()}


def _literal(row: Row, df: DataFrame, names: list[str]) -> Column:
    return F.struct(*(F.lit(row[n]).cast(df.schema[n].dataType) for n in names))
