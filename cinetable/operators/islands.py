"""Gap-separated islands of ordered events, and what is sequential inside them.

Rows are range-partitioned and sorted by (keys, time, id). An island ends where
the next event of its group is more than a gap away. Each partition numbers its
islands by itself; only its first and last can go on in a neighbour, and these
(at most two a partition) are chained by a window over their summaries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cinetable.functions.text import token_set_ratio
from cinetable.plans.columns import col
from cinetable.plans.lineage import materialise

_SHIFT = 1 << 40


def with_islands(df: DataFrame, keys: Sequence[str], time_ms: str, ident: str, *, gap_ms: int) -> DataFrame:
    """``df`` and ``island`` (bigint): equal for events of one group with no gap above ``gap_ms`` between them.

    Rows without a time are left out. Null keys form a group. An empty table
    stays empty; an input column called ``island`` is replaced.
    """
    kept = [c for c in df.columns if c != "island"]
    order = [col(c) for c in (*keys, time_ms, ident)]
    source = df.select(*(col(c) for c in kept)).where(col(time_ms).isNotNull())
    schema = T.StructType(
        list(source.schema.fields)
        + [T.StructField("_chunk", T.IntegerType()), T.StructField("_local", T.LongType())]
    )
    arrow = to_arrow_schema(schema)
    positions = [kept.index(k) for k in keys]
    at = kept.index(time_ms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, local = TaskContext.get().partitionId(), 0
        before_key, before_time = None, None
        for batch in batches:
            times = batch.column(at).to_pylist()
            groups = list(zip(*(batch.column(i).to_pylist() for i in positions))) if positions else [()] * len(times)
            numbers = []
            for key, t in zip(groups, times):
                if key != before_key or t - before_time > gap_ms:
                    local += 1
                before_key, before_time = key, t
                numbers.append(local)
            arrays = [c.cast(arrow.field(i).type) for i, c in enumerate(batch.columns)]
            arrays += [pa.array([chunk] * len(numbers), pa.int32()), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    placed = materialise(source.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    # summaries of the first and last island of each chunk
    ends = placed.groupBy("_chunk").agg(F.max("_local").alias("_top"))
    edge = placed.join(ends, "_chunk").where("_local = 1 or _local = _top")
    summaries = edge.groupBy("_chunk", "_local", *(col(k) for k in keys)).agg(
        F.min(col(time_ms)).alias("_t0"), F.max(col(time_ms)).alias("_t1")
    )
    in_order = Window.partitionBy(*(col(k) for k in keys)).orderBy("_chunk", "_local")
    begins = F.coalesce(F.col("_t0") - F.lag("_t1").over(in_order) > gap_ms, F.lit(True))
    own = F.col("_chunk").cast("bigint") * _SHIFT + F.col("_local")
    chained = (
        summaries.withColumn("_begins", begins)
        .withColumn("_own", own)
        .withColumn("_head", F.last(F.when(F.col("_begins"), F.col("_own")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .select("_chunk", "_local", "_head")
    )
    return placed.join(chained, ["_chunk", "_local"], "left").select(
        *(col(c) for c in kept), F.coalesce("_head", own).alias("island")
    )


_TEXT, _WHOLE, _REAL = T.StringType(), T.LongType(), T.DoubleType()
_BOXES = T.ArrayType(T.ArrayType(_REAL))


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


#: A part of a segment inside one chunk; parts of one segment share ``_from`` (the chunk and row of its first reading).
PART = _schema(
    ("_from", _WHOLE), ("_edge", T.BooleanType()), ("video_id", _TEXT), ("text", _TEXT), ("start_sec", _REAL), ("end_sec", _REAL),
    ("_ms", _WHOLE), ("_sum", _REAL), ("frames", _WHOLE), ("bboxes", _BOXES), ("_chunk", T.IntegerType()), ("_last", T.BooleanType()),
)


class _Open:
    """The open segment: where it began, its video and first text, when it was read last."""

    __slots__ = ("began", "video", "text", "ms")

    def __init__(self, began: int, video: str | None, text: str, ms: int) -> None:
        self.began, self.video, self.text, self.ms = began, video, text, ms

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Open) and (self.began, self.video, self.text, self.ms) == (other.began, other.video, other.text, other.ms)


def _encode_segments(entering: dict[int, _Open], similarity: float, gap_ms: int, ends_only: bool):
    """One pass over a sorted chunk that continues the segment left open before it."""
    arrow = to_arrow_schema(PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        now, part, first = entering.get(chunk), None, True
        row, out = chunk * _SHIFT, []

        def close(last: bool) -> None:
            nonlocal first
            if not ends_only or last:
                out.append((now.began, first or last, now.video, now.text, *part[:2], now.ms, *part[2:], chunk, last))
            first = False

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(values, type=field.type) for values, field in zip(zip(*out), arrow)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            for video, ms, ts, text, conf, box in zip(*(c.to_pylist() for c in batch.columns)):
                near = now is not None and now.video == video and ms - now.ms <= gap_ms
                if near and (text == now.text or token_set_ratio(text, now.text) >= similarity):
                    now = _Open(now.began, video, now.text, ms) if part is None else now
                    now.ms = ms
                    if part is None:
                        part = [ts, ts, 0.0, 0, []]
                else:
                    if part is not None:
                        close(False)
                    now, part = _Open(row, video, text, ms), [ts, ts, 0.0, 0, []]
                part[1] = ts
                part[2] += conf or 0.0
                part[3] += 1
                if not ends_only:
                    part[4].append(box)
                row += 1
                if len(out) > 20_000:
                    yield flush()
        if part is not None:
            close(True)
        if out:
            yield flush()

    return run


def text_segments(rows: DataFrame, *, similarity: float = 90.0, gap_ms: int = 1_000) -> DataFrame:
    """Segments of one screen text (W3, G8): video_id, text, start_sec, end_sec, avg_conf, frames, bboxes.

    ``rows``: video_id, det_id, frame_ts, text, conf, bbox. In order of time, a row
    extends the open segment if it is at most ``gap_ms`` after its last row and
    its words are similar enough to the segment's *first* text; otherwise it
    opens the next one. ``bboxes`` are those of the segment's rows in order.

    That is sequential, yet no video is gathered in a task: rows are range-sorted chunks.
    Each chunk is read from a guess of the segment open before it (at first none), which
    tells what it leaves open itself; the guesses are renewed until none changes. A
    chunk's end hardly ever depends on its beginning, so the first renewal is the last as a rule; in the worst
    case (one segment over many chunks) there is one pass a chunk. The passes run while the
    plan is built; the driver holds one open segment a chunk.

    Defined results: rows without a time are left out, a null text counts as "", a null
    confidence as 0; null video_ids are a group; an empty table gives no rows.
    """
    order = ["video_id", "_ms", "det_id"]
    source = rows.select(
        "video_id", "det_id", F.round(F.col("frame_ts") * 1000).cast("bigint").alias("_ms"), F.col("frame_ts").alias("_ts"),
        F.coalesce("text", F.lit("")).alias("text"), "conf", "bbox",
    ).where("_ms is not null")
    placed = materialise(source.repartitionByRange(*order).sortWithinPartitions(*order)).select("video_id", "_ms", "_ts", "text", "conf", "bbox")
    chunks = placed.rdd.getNumPartitions()
    entering: dict[int, _Open] = {}
    parts = None
    while True:
        found = placed.mapInArrow(_encode_segments(entering, similarity, gap_ms, parts is None and chunks > 1), PART)
        parts = materialise(found)
        if chunks <= 1:
            break
        left = {r["_chunk"]: _Open(r["_from"], r["video_id"], r["text"], r["_ms"]) for r in parts.where("_last").drop("bboxes").collect()}
        renewed, last = {}, None
        for chunk in range(chunks):
            if last is not None:
                renewed[chunk] = last
            last = left.get(chunk, last)
        if renewed == entering:
            break
        entering = renewed
    inner = parts.where("not _edge").select("video_id", "text", "start_sec", "end_sec", F.col("_sum"), "frames", "bboxes")
    merged = (
        parts.where("_edge")
        .groupBy("_from")
        .agg(
            F.first("video_id").alias("video_id"), F.first("text").alias("text"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"),
            F.sum("_sum").alias("_sum"), F.sum("frames").alias("frames"),
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "bboxes"))), lambda x: x["bboxes"])).alias("bboxes"),
        )
        .drop("_from")
    )
    return inner.unionByName(merged).select(
        "video_id", "text", "start_sec", "end_sec", F.round(F.col("_sum") / F.col("frames"), 3).alias("avg_conf"), "frames", "bboxes"
    )
