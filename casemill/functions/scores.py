"""Expressions over confidences and label codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNCLASSIFIED_CODE = "UNCLASSIFIED"
UNCLASSIFIED_NAME = "Unclassified"


def clip01(c: Column) -> Column:
    """Confidence within 0 and 1; what is not a number is missing."""
    return F.when(F.isnan(c), F.lit(None)).when(c < 0, F.lit(0.0)).when(c > 1, F.lit(1.0)).otherwise(c)


def at_least(c: Column, threshold: Column | float) -> Column:
    """Whether a score reaches the threshold; what is not a number does not."""
    return (c >= threshold) & ~F.isnan(c)


def null_if_blank(c: Column) -> Column:
    return F.when(c != "", c)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals, 0 for an empty table."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2)).otherwise(F.lit(0.0))


def confidence_band(c: Column) -> Column:
    value = F.coalesce(c, F.lit(0.0))
    return F.when(value > 0.7, "green").when(value > 0.4, "orange").otherwise("red")


def utc_stamp(c: Column) -> Column:
    """A timestamp text in one fixed format; what does not parse is kept."""
    parsed = F.try_to_timestamp(c)
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), c)


def code_or_unclassified(c: Column) -> Column:
    return F.coalesce(c, F.lit(UNCLASSIFIED_CODE))


def name_or_unclassified(c: Column) -> Column:
    return F.coalesce(c, F.lit(UNCLASSIFIED_NAME))
