"""Joins in time and by key.

Time conditions become equi-joins on (key, time bucket); the exact condition
stays as a residual. A key that holds a large share of all rows is spread over
its buckets, and no plan falls back to a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinetable.plans.columns import col

COARSER = 16


def _levels(longest: float | None, bucket: float) -> int:
    levels, width = 0, bucket * COARSER
    while longest is not None and width < longest:
        levels, width = levels + 1, width * COARSER
    return levels


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: Column, low: Column, high: Column, *, bucket: float, longest: float | None = None
) -> DataFrame:
    """Inner join: rows of both sides with equal ``keys`` and ``low <= at <= high``.

    ``longest`` is a bound of the intervals' length; without it one job finds it while the plan is built.

    ``at`` is over columns of ``points``, ``low`` and ``high`` over those of
    ``intervals``; ``keys`` exist on both sides and appear once. An interval
    longer than ``COARSER`` buckets uses buckets ``COARSER`` times as wide, and
    so on, so it makes at most ``COARSER + 1`` rows. Null keys or times match
    nothing. Other names must differ between the sides.
    """
    right = intervals.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    longest = right.agg(F.max(F.col("_high") - F.col("_low"))).first()[0] if longest is None else longest
    levels = _levels(longest, bucket)
    length = F.col("_high") - F.col("_low")
    level = F.lit(levels)
    for n in reversed(range(levels)):
        level = F.when(length <= bucket * COARSER ** (n + 1), n).otherwise(level)
    width = F.lit(bucket) * F.pow(F.lit(float(COARSER)), F.col("_level"))
    right = right.withColumn("_level", level.cast("int")).withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width)))
    )
    left = points.withColumn("_at", at).where(F.col("_at").isNotNull())
    if levels:
        left = left.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    else:
        left = left.withColumn("_level", F.lit(0))
    left = left.withColumn("_bucket", F.floor(F.col("_at") / width))
    joined = left.join(right, [*keys, "_level", "_bucket"]).where("_at >= _low and _at <= _high")
    return joined.drop("_level", "_bucket", "_at", "_low", "_high")


def points_with_intervals(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], ident: Sequence[str], at: Column, low: Column, high: Column, *, bucket: float
) -> DataFrame:
    """The left join of ``points_in_intervals``; ``ident`` identifies a row of ``points``."""
    matched = points_in_intervals(points, intervals, keys, at, low, high, bucket=bucket)
    alone = points.join(matched.select(*(col(i).alias(f"_{i}") for i in ident)).distinct(), [col(i).eqNullSafe(col(f"_{i}")) for i in ident], "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def overlap_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], bounds: tuple[str, str, str, str], *, bucket: int
) -> DataFrame:
    """Pairs with equal keys whose half-open intervals overlap: ``l.start < r.end and r.start < l.end``.

    ``bounds`` names left start, left end, right start, right end (whole
    numbers). Both sides are exploded to buckets; a pair counts in the bucket
    where the later of both starts lies, so it comes once.
    """
    ls, le, rs, re = bounds

    def buckets(start: str, end: str) -> Column:
        first, last = F.floor(col(start) / bucket), F.floor((col(end) - 1) / bucket)
        return F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array(first)))

    a = left.where(col(ls).isNotNull() & col(le).isNotNull()).withColumn("_bucket", buckets(ls, le))
    b = right.where(col(rs).isNotNull() & col(re).isNotNull()).withColumn("_bucket", buckets(rs, re))
    later = F.floor(F.greatest(col(ls), col(rs)) / bucket)
    return (
        a.join(b, [*keys, "_bucket"])
        .where((col(ls) < col(re)) & (col(rs) < col(le)) & (F.col("_bucket") == later))
        .drop("_bucket")
    )


def speakers_by_overlap(segments: DataFrame, turns: DataFrame, keys: Sequence[str], segment: str, *, bucket: int = 60_000) -> DataFrame:
    """``segments`` with the speaker who overlaps them most, ``UNK`` if none does.

    ``segments`` has start_ms and end_ms, ``turns`` has turn_start_ms,
    turn_end_ms and speaker; ``segment`` identifies a segment within ``keys``.
    Ties go to the speaker whose first overlapping turn begins first, then to
    the smaller name. Segments with null times get ``UNK``.
    """
    narrow = segments.select(*keys, segment, "start_ms", "end_ms")
    spoken = turns.select(*keys, "turn_start_ms", "turn_end_ms", "speaker")
    pairs = overlap_pairs(narrow, spoken, keys, ("start_ms", "end_ms", "turn_start_ms", "turn_end_ms"), bucket=bucket)
    shared = F.least("end_ms", "turn_end_ms") - F.greatest("start_ms", "turn_start_ms")
    sums = pairs.groupBy(*keys, segment, "speaker").agg(F.sum(shared).alias("_shared"), F.min("turn_start_ms").alias("_first"))
    best = sums.groupBy(*keys, segment).agg(
        F.min_by(F.struct("speaker", "_shared"), F.struct(-F.col("_shared"), F.col("_first"), F.col("speaker"))).alias("_best")
    )
    return segments.join(best, [*keys, segment], "left").select(
        *(col(c) for c in segments.columns),
        F.coalesce("_best.speaker", F.lit("UNK")).alias("speaker"),
        F.coalesce("_best._shared", F.lit(0)).alias("overlap_ms"),
    )


def with_contents(results: DataFrame, contents: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    """Web results with the best text there is (J7, X18, X23): columns ``keep``, id, title, url, snippet.

    A result's own trimmed text, else the content of its id, else the empty
    string; the title falls back to the url, then to ``(untitled)``."""
    from cinetable.functions.text import ellipsis

    other = contents.select(col("id"), F.trim("text").alias("_content"))
    joined = results.join(other, "id", "left")
    text = F.coalesce(F.expr("nullif(trim(text), '')"), F.col("_content"), F.lit(""))
    title = F.coalesce(F.expr("nullif(title, '')"), F.expr("nullif(url, '')"), F.lit("(untitled)"))
    return joined.select(
        *keep, "id", title.alias("title"), F.coalesce("url", F.lit("")).alias("url"), ellipsis(text, 800, 790, trim_end=True).alias("snippet")
    )


def with_neighbours(hits: DataFrame, chunks: DataFrame, keys: Sequence[str], *, before: int, after: int) -> DataFrame:
    """Each hit's neighbours by position (W2, J10): all columns of ``hits``, offset, neighbour.

    ``hits`` has keys and ``position``; ``chunks`` has keys, ``position`` and the
    columns that ``neighbour`` (a struct) holds. Positions beyond either end are
    left out. The join is on (keys, position), so no sequence is gathered.
    """
    wanted = hits.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn(
        "_at", F.col("position") + F.col("offset")
    )
    held = [c for c in chunks.columns if c not in keys]
    other = chunks.select(*keys, F.col("position").alias("_at"), F.struct(*(col(c) for c in held)).alias("neighbour"))
    return wanted.join(other, [*keys, "_at"]).drop("_at")
