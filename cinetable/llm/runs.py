"""Runs of identical or near-identical consecutive events as one row each.

Method: associative run summaries. Rows are range-partitioned and sorted by
(sequence, time, id); every partition encodes its runs in one pass, holding one
open run. Only the first and the last run of a partition can continue in a
neighbour, so at most two summaries per partition go through the prefix merge
that joins compatible last and first runs. A sequence that holds a large share
of all rows is cut by time into as many partitions as it needs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cinetable.functions.jsontext import json_field
from cinetable.plans.columns import col, to_ms
from cinetable.plans.lineage import materialise

Same = Callable[[tuple, tuple], bool]
FLUSH = 20_000


def _encoder(schema: pa.Schema, width: int, sigs: int, same: Same, gap_ms: int, min_count: int, whole: bool):
    """Encode one sorted partition; ``whole``: keep signatures of inner runs and join texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        out: list[tuple] = []
        key = last_sig = first_sig = None
        first_t = last_t = first_id = last_id = end = None
        texts: list[str] = []
        count, began = 0, 0

        def close(side: int | None) -> None:
            if side is not None or count >= min_count:
                ends = (*first_sig, *last_sig) if whole or side is not None else (None,) * (2 * sigs)
                out.append((*key, chunk, side, count, first_t, last_t, first_id, last_id, end, " ".join(texts) if whole else None, *ends))

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(values, type=field.type) for values, field in zip(zip(*out), schema)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                t, ident, row_end, text = row[width : width + 4]
                sig = row[width + 4 :]
                here = row[:width]
                if here == key:
                    if ident == last_id and t == last_t:
                        continue  # delivered again
                    if t - last_t <= gap_ms and same(last_sig, sig):
                        count += 1
                        last_t, last_id, last_sig = t, ident, sig
                        if row_end is not None and (end is None or row_end > end):
                            end = row_end
                        if text:
                            texts.append(text)
                        continue
                if key is not None:
                    close(1 if began == 1 else None)
                    if len(out) >= FLUSH:
                        yield flush()
                began += 1
                key, first_sig, last_sig = here, sig, sig
                first_t, last_t, first_id, last_id, end = t, t, ident, ident, row_end
                texts, count = [text] if text else [], 1
        if key is not None:
            close(3 if began == 1 else 2)
        if out:
            yield flush()

    return run


def collapse_runs(
    rows: DataFrame,
    keys: Sequence[str],
    time_ms: str,
    ident: str,
    signature: Sequence[str],
    same: Same,
    *,
    gap_ms: int,
    min_count: int = 1,
    end_ms: str | None = None,
    text: str | None = None,
    whole: bool = True,
) -> DataFrame:
    """One row per maximal run of consecutive compatible events of a sequence.

    Result columns: ``keys``, run_count, first_ms, last_ms, first_id, last_id,
    end_ms (greatest of column ``end_ms``), text (texts in order, joined by a
    space) and ``signature`` of the first event; the last two are null with
    ``whole=False``, which also moves less data. Neighbours belong together if
    they are at most ``gap_ms`` apart and ``same(previous, next)`` holds for
    their signature tuples.

    Defined results: rows without time or id are left out; null keys are a
    sequence of their own; equal times are ordered by id; a row with the key,
    time and id of its predecessor is that row delivered again and counts once;
    an empty table gives no rows; other columns are ignored whatever their names.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    sigs = [f"_g{i}" for i in range(len(signature))]
    narrow = rows.select(
        *(col(k).alias(n) for k, n in zip(keys, names)),
        col(time_ms).cast("bigint").alias("_t"),
        col(ident).cast("bigint").alias("_id"),
        (col(end_ms).cast("bigint") if end_ms else F.lit(None).cast("bigint")).alias("_end"),
        (col(text) if text else F.lit(None).cast("string")).alias("_text"),
        *(col(s).cast("string").alias(g) for s, g in zip(signature, sigs)),
    ).where("_t is not null and _id is not null")
    ints = [("_chunk", T.IntegerType()), ("_side", T.IntegerType()), ("_n", T.LongType())]
    longs = [(n, T.LongType()) for n in ("_t0", "_t1", "_id0", "_id1", "_end")]
    texts = [(n, T.StringType()) for n in ("_text", *(f"{g}a" for g in sigs), *(f"{g}b" for g in sigs))]
    schema = T.StructType(
        [f for f in narrow.schema if f.name in names]
        + [T.StructField(n, kind) for n, kind in ints + longs + texts]
    )
    order = [*names, "_t", "_id"]
    encoded = materialise(
        narrow.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            _encoder(to_arrow_schema(schema), len(names), len(sigs), same, gap_ms, min_count, whole), schema
        )
    )

    # prefix merge of the partitions' first (bit 1) and last (bit 2) runs
    @F.pandas_udf(T.BooleanType())
    def compatible(*both: pd.Series) -> pd.Series:
        pairs = zip(*(column.astype(object).where(column.notna(), None) for column in both))
        return pd.Series([bool(same(pair[: len(sigs)], pair[len(sigs) :])) for pair in pairs], dtype="bool")

    in_order = Window.partitionBy(*names).orderBy("_chunk", "_side")
    before = F.lag("_t1").over(in_order)
    edges = encoded.where("_side is not null").select(
        "*", (F.col("_t0") - before <= gap_ms).alias("_near"), *(F.lag(f"{g}b").over(in_order).alias(f"{g}p") for g in sigs)
    )
    edges = edges.withColumn(
        "_joins", F.coalesce("_near", F.lit(False)) & compatible(*(f"{g}p" for g in sigs), *(f"{g}a" for g in sigs))
    )
    edges = edges.withColumn(
        "_run", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    )
    place = F.struct("_chunk", "_side")
    merged = edges.groupBy(*names, "_run").agg(
        F.sum("_n").alias("_n"),
        F.min("_t0").alias("_t0"),
        F.max("_t1").alias("_t1"),
        F.min_by("_id0", place).alias("_id0"),
        F.max_by("_id1", place).alias("_id1"),
        F.max("_end").alias("_end"),
        F.concat_ws(
            " ", F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_side", "_text"))), lambda x: x["_text"])
        ).alias("_text"),
        *(F.min_by(f"{g}a", place).alias(f"{g}a") for g in sigs),
    )
    columns = [*names, "_n", "_t0", "_t1", "_id0", "_id1", "_end", "_text", *(f"{g}a" for g in sigs)]
    done = encoded.where("_side is null").select(*columns).unionByName(merged.select(*columns))
    if min_count > 1:
        done = done.where(F.col("_n") >= min_count)
    return done.select(
        *(F.col(n).alias(k) for n, k in zip(names, keys)),
        F.col("_n").alias("run_count"),
        F.col("_t0").alias("first_ms"),
        F.col("_t1").alias("last_ms"),
        F.col("_id0").alias("first_id"),
        F.col("_id1").alias("last_id"),
        F.col("_end").alias("end_ms"),
        F.col("_text").alias("text"),
        *(F.col(f"{g}a").alias(f"run_{s}") for g, s in zip(sigs, signature)),
    )


# --- what detections of one object or one screen text have in common -------

NEAR = 0.3  # share of the letters that may differ between readings of one text


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit-parallel columns (Hyyrö's form of Myers' method)."""
    if not a or not b:
        return max(len(a), len(b))
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for ch in b:
        match = where.get(ch, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right = down | ~(diagonal | up) & full
        left = up & diagonal
        if right & top:
            distance += 1
        elif left & top:
            distance -= 1
        right = right << 1 | 1
        left <<= 1
        up = (left | ~(diagonal | right)) & full
        down = right & diagonal & full
    return distance


@lru_cache(maxsize=50_000)
def _letters_and_numbers(text: str) -> tuple[str, tuple[str, ...]]:
    plain = unicodedata.normalize("NFKD", text.casefold())
    return "".join(ch for ch in plain if ch.isalpha()), tuple(re.findall(r"\d+", plain))


@lru_cache(maxsize=50_000)
def _near_letters(a: str, b: str) -> bool:
    limit = int(NEAR * max(len(a), len(b)))
    return abs(len(a) - len(b)) <= limit and edit_distance(a, b) <= limit


def near_text(a: str, b: str) -> bool:
    """Readings of one screen text: letters nearly equal, numbers equal."""
    if a == b:
        return True
    (letters_a, numbers_a), (letters_b, numbers_b) = _letters_and_numbers(a), _letters_and_numbers(b)
    if numbers_a != numbers_b:
        return False
    return letters_a == letters_b or _near_letters(letters_a, letters_b)


def same_object(a: tuple, b: tuple) -> bool:
    """(track, text) of neighbours: same track, nearly the same text, or neither in both."""
    (track_a, text_a), (track_b, text_b) = a, b
    if track_a is not None and track_a == track_b:
        return True
    if text_a is not None and text_b is not None and near_text(text_a, text_b):
        return True
    return track_a is None and text_a is None and track_b is None and text_b is None


def detection_runs(detections: DataFrame, *, gap_ms: int = 1_000, min_count: int = 1, whole: bool = True) -> DataFrame:
    """Runs of one object or screen text in ``detections``.

    Columns: video_id, label (lower case, outer space removed), run_count,
    first_det_id, last_det_id, first_frame_ts, last_frame_ts (seconds), track
    and text of the first detection (null with ``whole=False``).

    Detections without ``frame_ts`` are left out. ``extra`` that is null, blank,
    no JSON object or without ``track`` and ``text`` says neither. Null labels
    and null video_ids form sequences of their own.
    """
    track = F.regexp_replace(F.trim(json_field(F.col("extra"), "$.track")), r"\.0+$", "")
    rows = detections.select(
        "video_id",
        F.lower(F.trim("label")).alias("label"),
        to_ms(F.col("frame_ts")).alias("ms"),
        "det_id",
        track.alias("track"),
        json_field(F.col("extra"), "$.text").alias("said"),
    )
    runs = collapse_runs(
        rows, ["video_id", "label"], "ms", "det_id", ["track", "said"], same_object,
        gap_ms=gap_ms, min_count=min_count, whole=whole,
    )
    return runs.select(
        "video_id",
        "label",
        "run_count",
        F.col("first_id").alias("first_det_id"),
        F.col("last_id").alias("last_det_id"),
        (F.col("first_ms") / 1000).alias("first_frame_ts"),
        (F.col("last_ms") / 1000).alias("last_frame_ts"),
        F.col("run_track").alias("track"),
        F.col("run_said").alias("text"),
    )
