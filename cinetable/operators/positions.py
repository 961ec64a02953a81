"""Ordered positions of rows without gathering a group in one task.

Rows are range-partitioned and sorted; a row's position is its place in its
partition plus the number of rows of its group in the partitions before. A
group that holds a large share of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinetable.plans.columns import col
from cinetable.plans.lineage import materialise


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """``df`` and ``name``: 0, 1, ... within ``keys`` in ``order`` (ascending, nulls first).

    ``order`` must be total within a group for the result to be determined; null
    keys form a group; an empty table stays empty; an input column called
    ``name`` is replaced.
    """
    kept = [c for c in df.columns if c != name]
    by = [col(c) for c in (*keys, *order)]
    placed = materialise(
        df.select(*(col(c) for c in kept))
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_chunk", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    group = [F.coalesce(col(k).cast("string"), F.lit("\0null")) for k in keys]
    placed = placed.withColumn("_group", F.to_json(F.array(*group)) if keys else F.lit(""))
    sizes = placed.groupBy("_group", "_chunk").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("_group").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return placed.join(sizes, ["_group", "_chunk"]).select(
        *(col(c) for c in kept), (F.col("_before") + F.col("_place") - F.col("_first")).alias(name)
    )
