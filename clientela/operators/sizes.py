"""Measuring a list of keys before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a key list is broadcast only after its rows and bytes were counted and found within these
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20


def key_list_size(keys: DataFrame) -> tuple[int, int]:
    """Rows and bytes of a one-column list; counted on the executors, one row comes back."""
    width = F.octet_length(F.col(keys.columns[0]).cast("string"))
    return tuple(keys.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first())


def may_broadcast(size: tuple[int, int], max_rows: int = BROADCAST_ROWS) -> bool:
    rows, width = size
    return rows <= max_rows and width <= BROADCAST_BYTES
