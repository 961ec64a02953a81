"""Continuous periods and gaps of overlapping, nested or separate intervals.

Method: an ordered map of disjoint intervals per entity in keyed state; each
insertion finds its neighbours by binary search and merges what it touches.

The input is range-partitioned by (entity, start), so an entity that holds a
large share of all rows is spread over many tasks and every task's state is
bounded by its partition. Only the first and the last entity of a partition can
continue in a neighbouring one; their summaries (at most two rows per
partition) carry the running end across partitions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cinetable.plans.columns import col, to_ms
from cinetable.plans.lineage import materialise


class IntervalMap:
    """Disjoint intervals in order; touching intervals are one."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: Sequence[int] = (), ends: Sequence[int] = ()) -> None:
        self.starts, self.ends = list(starts), list(ends)

    def insert(self, start: int, end: int) -> None:
        # all intervals [lo, hi) overlap or touch the new one
        lo = bisect_left(self.ends, start)
        hi = bisect_right(self.starts, end)
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi] = [start]
        self.ends[lo:hi] = [end]

    def periods(self) -> Iterator[tuple[int, int, int | None]]:
        """(start, end, end of the preceding period) in order."""
        before = None
        for start, end in zip(self.starts, self.ends):
            yield start, end, before
            before = end


def _merge_partition(schema: pa.Schema, width: int):
    """Entities in order, starts in order within them: an insertion is at the end of the map, and an
    entity is put out as soon as the next begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        out: list[tuple] = []
        key, entry, began = None, IntervalMap(), 0

        def close(side: int | None) -> Iterator[pa.RecordBatch]:
            for start, end, before in entry.periods():
                out.append((*key, chunk, side, start, end, before))
                if len(out) >= 20_000:
                    yield flush()

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(values, type=field.type) for values, field in zip(zip(*out), schema)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if row[:width] != key:
                    if began:
                        yield from close(0 if began == 1 else None)
                    key, entry, began = row[:width], IntervalMap(), began + 1
                entry.insert(row[width], row[width + 1])
        if began:
            yield from close(0 if began == 1 else 1)
        if out:
            yield flush()

    return run


def continuous_periods(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    *,
    max_gap_ms: int | None = None,
    seconds: bool = True,
) -> DataFrame:
    """Periods and gaps per entity: columns ``keys``, kind, start_ms, end_ms.

    ``kind`` is ``period`` (a maximal union of intervals that overlap or touch)
    or ``gap`` (the space between consecutive periods, left out if longer than
    ``max_gap_ms``). ``start`` and ``end`` are seconds (rounded to ms) or, with
    ``seconds=False``, whole milliseconds.

    Defined results: a null, NaN or infinite end, or an end not after its start,
    makes an interval unusable, it is left out; null keys form an entity of
    their own; repeated rows change nothing; an empty table gives no rows;
    further columns are ignored whatever their names.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    as_ms = to_ms if seconds else (lambda c: c.cast("bigint"))
    rows = df.select(
        *(col(k).alias(n) for k, n in zip(keys, names)),
        as_ms(col(start)).alias("_s"),
        as_ms(col(end)).alias("_e"),
    ).where("_e > _s")
    schema = T.StructType(
        [f for f in rows.schema if f.name not in ("_s", "_e")]
        + [T.StructField("_chunk_", T.IntegerType()), T.StructField("_side_", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("_s_", "_e_", "_before_")]
    )
    arrow = to_arrow_schema(schema)
    pieces = materialise(
        rows.repartitionByRange(*names, "_s").sortWithinPartitions(*names, "_s").mapInArrow(_merge_partition(arrow, len(keys)), schema)
    )

    # summaries of the at most two entities of a chunk that neighbours may share
    edge = pieces.where("_side_ is not null")
    in_order = Window.partitionBy(*names).orderBy("_chunk_")
    carried = (
        edge.groupBy(*names, "_chunk_", "_side_")
        .agg(F.max("_e_").alias("_top"))
        .select(
            "_chunk_",
            "_side_",
            F.max("_top").over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
        )
    )
    joined = pieces.join(carried, ["_chunk_", "_side_"], "left").withColumn(
        "_new", F.coalesce(F.col("_s_") > F.col("_carry"), F.lit(True))
    )

    # what an edge entity's later chunks add to the last period begun before them
    last_new = (
        joined.where("_side_ is not null")
        .groupBy(*names, "_chunk_", "_side_")
        .agg(
            F.max(F.when(F.col("_new"), F.col("_s_"))).alias("_last"),
            F.max(F.when(~F.col("_new"), F.col("_e_"))).alias("_absorbed"),
        )
    )
    target = F.last("_last", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    extension = (
        last_new.withColumn("_target", target)
        .where("_absorbed is not null")
        .groupBy(*names, F.col("_target").alias("_s_"))
        .agg(F.max("_absorbed").alias("_ext"))
    )
    owner = last_new.where("_last is not null").select(*names, "_chunk_", "_side_", F.col("_last").alias("_s_"))
    same = [owner[n].eqNullSafe(extension[n]) for n in names] + [owner["_s_"] == extension["_s_"]]
    extension = owner.join(extension, same).select(
        owner["_chunk_"], owner["_side_"], owner["_s_"], extension["_ext"]
    )
    periods = (
        joined.where("_new")
        .join(extension, ["_chunk_", "_side_", "_s_"], "left")
        .select(
            *names,
            "_s_",
            F.greatest("_e_", "_ext").alias("_e_"),
            F.greatest("_before_", "_carry").alias("_gap"),
        )
    )
    gap_ok = F.col("_gap").isNotNull()
    if max_gap_ms is not None:
        gap_ok = gap_ok & (F.col("_s_") - F.col("_gap") <= max_gap_ms)
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("_s_").alias("start_ms"), F.col("_e_").alias("end_ms")),
        F.when(
            gap_ok,
            F.struct(F.lit("gap").alias("kind"), F.col("_gap").alias("start_ms"), F.col("_s_").alias("end_ms")),
        ),
    )
    return (
        periods.select(*names, F.explode(F.filter(both, lambda x: x.isNotNull())).alias("_x"))
        .select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "_x.kind", "_x.start_ms", "_x.end_ms")
    )

