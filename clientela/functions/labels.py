"""Labels: channels, categories, segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clientela import constants as K
from clientela.params import SEGMENTS, SegmentRule


def channel_label(online_system: str = K.ONLINE_SYSTEM) -> Column:
    return F.when(F.col("source_system") == online_system, K.ONLINE_LABEL).otherwise(F.col("store"))


def category_label(category: Column, prefixes: tuple[tuple[str, str], ...]) -> Column:
    """Label of the first matching prefix, else the category as it is."""
    lowered = F.lower(category)
    label = category
    for prefix, name in reversed(prefixes):
        label = F.when(lowered.startswith(prefix), name).otherwise(label)
    return label


def rfm_segment(r: Column, f: Column, m: Column, rules: tuple[SegmentRule, ...] = SEGMENTS) -> Column:
    """Name of the first rule that fits the tiles, for any number of tiles."""
    label = F.lit(K.OTHER_SEGMENT)
    for rule in reversed(rules):
        label = F.when(rule.fits(r, f, m), rule.name).otherwise(label)
    return label
