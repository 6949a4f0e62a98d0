"""Expressions over ``array<float>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(inner_product(v, v))


def unit(v: Column, element: str = "float") -> Column:
    """``v`` scaled to length one; a zero vector stays as it is."""
    norm = l2_norm(v)
    divisor = F.when(norm == 0.0, F.lit(1.0)).otherwise(norm)
    # The repeated array holds the norm, so it is computed once and not per element.
    return F.zip_with(
        v, F.array_repeat(divisor, F.size(v)), lambda x, n: (x.cast("double") / n).cast(element)
    )
