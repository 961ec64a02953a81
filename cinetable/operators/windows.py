"""Time windows, context, budgets and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinetable.functions.timetext import srt_text
from cinetable.plans.columns import col


def time_windows(
    entries: DataFrame, keys: Sequence[str], order: str, *, window_ms: int = 5_000, anchor: str = "first"
) -> DataFrame:
    """Anchored windows with the texts that overlap them.

    ``entries``: keys, ``order`` (file order), start_ms, end_ms, text. Window i
    of a group begins i x ``window_ms`` after the anchor, the start of the first
    entry in file order (``first``) or 0 (``zero``), and ends with the group's
    greatest end at the latest. An entry is in every window that it overlaps by
    more than a point; windows without text are left out but keep their number.

    Result: keys, window_no, chunk_id, start_ms, end_ms, start_srt, end_srt, text.
    Entries without times are left out, a null text counts as "". The per-group
    facts are pre-aggregated; windows are grouped by (keys, window), so a large
    group is spread over its windows.
    """
    usable = entries.where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    first = F.min_by("start_ms", F.struct(order, "start_ms")) if anchor == "first" else F.lit(0).cast("bigint")
    facts = usable.groupBy(*(col(k) for k in keys)).agg(first.alias("_anchor"), F.max("end_ms").alias("_top"))
    same = [usable[k].eqNullSafe(facts[k]) for k in keys]
    joined = usable.join(facts, same).drop(*(facts[k] for k in keys)) if keys else usable.crossJoin(facts)
    low = F.greatest(F.floor((F.col("start_ms") - F.col("_anchor")) / window_ms), F.lit(0))
    high = F.ceil((F.least("end_ms", "_top") - F.col("_anchor")) / window_ms) - 1
    spread = (
        joined.withColumns({"_low": low.cast("bigint"), "_high": high.cast("bigint")})
        .where("_low <= _high and start_ms < _top")
        .withColumn("window_no", F.explode(F.sequence("_low", "_high")))
        .withColumn("_from", F.col("_anchor") + F.col("window_no") * window_ms)
        .where((F.col("end_ms") > F.col("_from")) & (F.col("start_ms") < F.col("_from") + window_ms))
    )
    grouped = spread.groupBy(*(col(k) for k in keys), "window_no", "_from", "_top").agg(
        F.array_sort(F.collect_list(F.struct(col(order).alias("_o"), F.col("start_ms"), F.coalesce("text", F.lit("")).alias("_t")))).alias("_texts")
    )
    text = F.trim(F.array_join(F.transform("_texts", lambda x: x["_t"]), " "))
    end = F.least(F.col("_from") + window_ms, F.col("_top"))
    return grouped.select(
        *(col(k) for k in keys),
        "window_no",
        F.format_string("win_%06d_%010d", "window_no", "_from").alias("chunk_id"),
        F.col("_from").alias("start_ms"),
        end.alias("end_ms"),
        srt_text(F.col("_from") / 1000).alias("start_srt"),
        srt_text(end / 1000).alias("end_srt"),
        text.alias("text"),
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank from 1.

    Spark cuts every partition to ``n`` rows a group before the shuffle. ``order``
    should end in a unique column."""
    ranked = F.row_number().over(Window.partitionBy(*(col(k) for k in keys)).orderBy(*order))
    return df.withColumn(name, ranked).where(F.col(name) <= n)


def first_distinct(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` records in ``order``, of which ``df`` may hold copies with equal ``keys`` and order; no shuffle of the table.

    If the first rows hold ``n`` different records, these are the first of all; else more rows are looked at. That is
    found out by small jobs while the plan is built."""
    rows = 4 * n
    while True:
        part = df.orderBy(*order).limit(rows)
        seen, held = part.agg(F.count_distinct(F.struct(*(col(k) for k in keys))), F.count("*")).first()
        if seen >= n or held < rows:
            return part.dropDuplicates(list(keys)).orderBy(*order).limit(n)
        rows *= 4


def trimmed_history(messages: DataFrame, keys: Sequence[str], position: str, *, max_messages: int = 8, max_chars: int = 6_000) -> DataFrame:
    """The newest messages within a budget, as messages (W5): keys, position, role, content.

    Of the last ``max_messages`` in order, kept while the characters before a
    message are below the budget; the last one kept is cut to what is left. So
    the budget drops the newest. Null content counts as "", a null role as ``user``."""
    recent = _recent(messages, keys, position, max_messages)
    content = F.trim(F.coalesce("content", F.lit("")))
    order = Window.partitionBy(*(col(k) for k in keys)).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(content)).over(order), F.lit(0))
    counted = recent.select(
        *(col(k) for k in keys), position, F.coalesce("role", F.lit("user")).alias("role"), content.alias("_content"), used.alias("_used")
    ).where(F.col("_used") < max_chars)
    kept = F.expr(f"substring(_content, 1, cast({max_chars} - _used as int))")
    return counted.select(*(col(k) for k in keys), position, "role", kept.alias("content"))


def history_text(messages: DataFrame, keys: Sequence[str], position: str, *, max_messages: int = 8, max_chars: int = 6_000) -> DataFrame:
    """The newest messages as one text a group (W5): keys, history. Lines are never cut; the line that
    reaches the budget is the last."""
    recent = _recent(messages, keys, position, max_messages)
    role = F.when(F.coalesce("role", F.lit("user")) == "user", "User").otherwise("Assistant")
    line = F.concat(role, F.lit(": "), F.trim(F.coalesce("content", F.lit(""))))
    order = Window.partitionBy(*(col(k) for k in keys)).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("_line")).over(order), F.lit(0))
    kept = recent.withColumn("_line", line).withColumn("_used", used).where(F.col("_used") < max_chars)
    lines = F.array_sort(F.collect_list(F.struct(position, "_line")))
    return kept.groupBy(*(col(k) for k in keys)).agg(
        F.array_join(F.transform(lines, lambda x: x["_line"]), "\n").alias("history")
    )


def _recent(messages: DataFrame, keys: Sequence[str], position: str, n: int) -> DataFrame:
    return top_per_group(messages, keys, [F.col(position).desc()], n, "_age").drop("_age")


def rescaled(df: DataFrame, columns: Sequence[str], factor: float) -> DataFrame:
    """Times multiplied by a playback factor; factors within 0.001 of 1 change nothing."""
    if abs(factor - 1.0) <= 1e-3:
        return df
    return df.withColumns({c: col(c) * F.lit(factor) for c in columns})


def atempo_steps(factor: float) -> list[float]:
    """A tempo factor as a product of steps between 0.5 and 2."""
    steps = []
    while not 0.5 <= factor <= 2.0:
        hop = 2.0 if factor > 2.0 else 0.5
        steps.append(hop)
        factor /= hop
    return [*steps, factor]


def frame_times(frames: DataFrame, *, target_fps: float | Column, native_fps: float, batch: int | None = None) -> DataFrame:
    """Sampled frames with their times (F6, W8): all columns of ``frames`` (frame_idx, pts_seconds), sample_no, ts.

    Every ``step``-th frame is kept, step being native / target rounded
    half-even, at least 1; ``target_fps`` may be a column. A frame's time is its own pts, else frame_idx / native.
    With ``batch`` the time is the older batch-relative one, first time of the
    batch plus place / target, which runs backwards between batches when the
    rates don't divide; it is offered for comparison only.
    """
    rate = target_fps if isinstance(target_fps, Column) else F.lit(float(target_fps))
    step = F.greatest(F.lit(1), F.bround(F.lit(float(native_fps)) / rate, 0).cast("int"))
    kept = frames.where(F.col("frame_idx") % step == 0)
    own = F.coalesce("pts_seconds", F.col("frame_idx") / F.lit(float(native_fps)))
    kept = kept.withColumn("sample_no", F.floor(F.col("frame_idx") / step).cast("bigint")).withColumn("ts", own)
    if batch is None:
        return kept
    place = F.col("sample_no") % batch
    start = F.min_by("ts", "sample_no").over(Window.partitionBy(F.floor(F.col("sample_no") / batch)))
    return kept.withColumn("ts", start + place / rate)
