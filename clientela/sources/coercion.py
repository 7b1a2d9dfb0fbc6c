"""Turning text columns into numbers, a whole column or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|(?i)^\s*([+-]?(inf|infinity)|nan)\s*$"


def coerce_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cast those text columns whose every value reads as a number; empty text counts as missing.

    One pass over the columns decides for all of them. Whole numbers without gaps become
    ``bigint``, everything else ``double``. Do not use it on ids: leading zeros get lost.
    """
    if columns is None:
        columns = [name for name, kind in df.dtypes if kind == "string"]
    if not columns:
        return df
    checks = []
    for name in columns:
        value = F.col(name)
        missing = value.isNull() | (value == "")
        whole = F.coalesce(value.rlike(_WHOLE) & value.try_cast("bigint").isNotNull(), F.lit(False))
        number = missing | value.rlike(_NUMBER)
        checks += [F.bool_and(whole).alias(f"{name}_whole"), F.bool_and(number).alias(f"{name}_number")]
    found = df.agg(*checks).first()
    casts = {}
    for i, name in enumerate(columns):
        if found[2 * i]:
            casts[name] = F.trim(name).cast("bigint")
        elif found[2 * i + 1]:
            casts[name] = F.col(name).try_cast("double")
    return df.withColumns(casts) if casts else df
