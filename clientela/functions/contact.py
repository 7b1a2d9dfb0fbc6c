"""Phone numbers and first names as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clientela import constants as K

# a decimal number as typed by people: sign, digits (may be grouped with _), fraction, exponent
_NUMBER = (
    r"(?U)^\s*([+-]?(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)"
    r"(?:[eE][+-]?[0-9](?:_?[0-9])*)?)\s*$"
)


def _whole_number_text(value: Column, noise: str) -> Column:
    """Text of the whole part of a typed number; NULL where the text is no number."""
    cleaned = F.regexp_replace(value.cast("string"), noise, "")
    number = F.regexp_replace(F.regexp_extract(cleaned, _NUMBER, 1), "_", "")
    return number.try_cast("double").try_cast("bigint").cast("string")


def whatsapp_number(area_code: Column, phone: Column) -> Column:
    """``55<area><phone>`` without punctuation or leading zeros, ``''`` where either part is unusable."""
    joined = F.concat(
        F.lit("55"),
        _whole_number_text(area_code, "[() ]"),
        _whole_number_text(phone, "[- ]"),
    )
    return F.coalesce(joined, F.lit(""))


def first_name(full_name: Column) -> Column:
    """First word with a capital initial, ``''`` where there is none."""
    return F.coalesce(F.initcap(F.regexp_extract(full_name, r"(?U)^\s*(\S+)", 1)), F.lit(""))


def phone_digits(area_code: Column, phone: Column) -> Column:
    """Area code and phone as stored, for searching."""
    blank = F.lit("")
    return F.concat(
        F.coalesce(area_code.cast("string"), blank), F.coalesce(phone.cast("string"), blank)
    )


def delivery_channel(source_system: Column) -> Column:
    return F.when(F.upper(source_system) == K.ONLINE_SYSTEM, "ecommerce").otherwise("loja")
