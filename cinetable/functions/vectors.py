"""Dense vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if either side or an element is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    length = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))
