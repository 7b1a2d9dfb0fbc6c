"""Text formats of numbers and exact rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_brl(value: Column) -> Column:
    """``R$ 1.234,56``; NULL and NaN read as zero."""
    shown = F.format_number(F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0)), 2)
    return F.concat(F.lit("R$ "), F.translate(shown, ",.", ".,"))


def format_count(value: Column) -> Column:
    """Whole part with ``.`` between thousands; NULL and NaN read as zero."""
    whole = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0)).cast("bigint")
    return F.translate(F.format_number(whole, 0), ",", ".")


def format_share(value: Column) -> Column:
    """One decimal, ties to even, followed by ``%``."""
    return F.concat((F.rint(value * 10) / 10).cast("string"), F.lit("%"))


def rounded_ratio(numerator: str, denominator: str, scale: int = 1) -> Column:
    """``round(scale * numerator / denominator)`` on whole numbers, half up, without floating point.

    For non-negative numerators. NULL where the denominator is zero.
    """
    return F.expr(
        f"(2 * {scale} * {numerator} + {denominator}) div nullif(2 * {denominator}, 0)"
    )


def mean(total: Column, rows: Column) -> Column:
    """Mean out of an exact sum: the same whatever the order rows arrive in."""
    return total.cast("double") / F.nullif(rows, F.lit(0))


def percent(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0)) * 100
