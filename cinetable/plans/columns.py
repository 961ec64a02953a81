"""Column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def to_ms(seconds: Column) -> Column:
    """Seconds to whole milliseconds; null, NaN and infinite values give null."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(9.0e15))
    return F.when(finite, F.round(seconds * 1000).cast("bigint"))


def other_columns(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` that are named otherwise, in Spark's sense (case doesn't matter)."""
    taken = {name.lower() for name in names}
    return [c for c in df.columns if c.lower() not in taken]


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it new to ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
