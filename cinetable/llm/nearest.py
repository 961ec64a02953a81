"""Each event with the nearest interval of the same entity within a tolerance.

Method: tick expansion. Intervals are exploded to every discrete tick they can
serve, each entity-tick keeps the best candidates, and the events' own ticks
are equi-joined. The join key is (entity, tick), so an entity that holds a large
share of all rows is spread over its ticks. No range condition reaches the join.

A tick is coarser than a millisecond, yet the result is exact: per entity-tick
the intervals that end before it are represented by the best of them, so are
those that start after it, and those that reach into it by the best of each
pair of ends clipped to the tick. Events of one millisecond share one search.
Intervals much longer than a tick use ticks of higher levels, ``COARSER`` times
as long each, for the part they cover, so a very long interval makes few rows.

Where more than ``DENSE`` ends lie in one entity-tick, the intervals that reach
into it are exploded to finer ticks instead, each level ``FINER`` times finer down to
a millisecond. Such a cell keeps at most three candidates (before, after, all over
it), so an event meets a bounded number of them however many intervals there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from cinetable.plans.columns import to_ms

COARSER = 64
FINER = 8
DENSE = 512
BEFORE, AFTER, OVER = -1, -2, -3  # slots of a tick's candidates; other slots are pairs of clipped ends


def media_key(video_id: Column) -> Column:
    """The one spelling of a video's id: lower case, ``_`` for ``-`` and space, no media suffix."""
    bare = F.regexp_replace(F.lower(F.trim(video_id)), r"\.(?:mp4|mkv|mov|avi|webm|m4v|mpe?g|ts|srt|wav|mp3)$", "")
    return F.regexp_replace(bare, r"[\s\-]+", "_")


def _shape(intervals: DataFrame, tick_ms: int) -> tuple[int, bool]:
    """How many coarser levels the longest interval needs, and whether there are dense entity-ticks. One small job."""
    per_tick = _ends(intervals, tick_ms).agg(F.max("long").alias("long"), F.count("*").alias("n"))
    longest, most = per_tick.agg(F.max("long"), F.max("n")).first()
    levels, width = 0, tick_ms * COARSER
    while width <= (longest or 0):
        levels, width = levels + 1, width * COARSER
    return levels, (most or 0) > DENSE


def _ends(intervals: DataFrame, tick_ms: int) -> GroupedData:
    ticks = F.explode(F.array(*(F.floor(F.col(c) / tick_ms).cast("bigint") for c in ("s", "e"))))
    return intervals.select("entity", ticks.alias("tick"), (F.col("e") - F.col("s")).alias("long")).groupBy("entity", "tick")


def _finer_widths(tick_ms: int) -> list[int]:
    widths = [tick_ms]
    while widths[-1] > 1:
        widths.append(-(-widths[-1] // FINER))
    return widths


def _cell(at: Column, tick_ms: int, depth: int) -> Column:
    """Where the cell of ``depth`` (0: a tick) that holds a moment begins."""
    begin = F.floor(at / tick_ms).cast("bigint") * tick_ms
    for width in _finer_widths(tick_ms)[1 : depth + 1]:
        begin = begin + F.floor((at - begin) / width).cast("bigint") * width
    return begin


def _covered(level: int, tick_ms: int) -> tuple[Column, Column]:
    """First and (exclusive) last tick of a level that lies wholly in [s, e]."""
    width = tick_ms * COARSER**level
    return F.ceil(F.col("s") / width).cast("bigint"), F.floor((F.col("e") + 1) / width).cast("bigint")


def _range(first: Column, stop: Column, level: int) -> Column:
    ticks = F.when(stop > first, F.sequence(first, stop - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(ticks, lambda t: F.struct(F.lit(level).alias("level"), t.alias("tick")))


def _all_ticks(levels: int, tick_ms: int, within_ms: int) -> Column:
    parts = []
    for level in range(levels + 1):
        if level == 0:
            first = F.floor((F.col("s") - within_ms) / tick_ms).cast("bigint")
            stop = F.floor((F.col("e") + within_ms) / tick_ms).cast("bigint") + 1
        else:
            first, stop = _covered(level, tick_ms)
        if level == levels:
            parts.append(_range(first, stop, level))
            continue
        low, high = _covered(level + 1, tick_ms)
        nested = high > low
        parts.append(_range(first, F.when(nested, low * COARSER).otherwise(stop), level))
        parts.append(F.when(nested, _range(high * COARSER, stop, level)).otherwise(_range(stop, stop, level)))
    return F.concat(*parts)


def _placed(rows: DataFrame, low: Column, high: Column, inner: Column) -> DataFrame:
    """Rows with the slot of their candidate in the tick from ``low`` to ``high``; ``inner`` is the slot of those that reach into it."""
    slot = F.when(F.col("e") <= low, BEFORE).when(F.col("s") >= high, AFTER).when((F.col("s") <= low) & (F.col("e") >= high), OVER).otherwise(inner)
    near = F.when(F.col("slot") == BEFORE, F.col("e")).when(F.col("slot") == AFTER, -F.col("s")).otherwise(0)
    best = F.struct(near.alias("near"), F.col("s"), (-F.col("interval")).alias("low_id"), F.col("name"))
    return rows.withColumn("slot", slot.cast("bigint")).select("entity", "level", "tick", "slot", best.alias("best"))


def _children(begin: Column, last: Column, depth: int, width: int) -> Column:
    """The cells of ``width`` from ``begin`` to ``last``."""
    firsts = F.sequence(begin, last, F.lit(width).cast("bigint"))
    return F.transform(firsts, lambda c: F.struct(F.lit(-depth).alias("level"), c.alias("tick"), F.least(c + width - 1, last).alias("high")))


def _dense_cells(rows: DataFrame, tick_ms: int) -> DataFrame:
    """Candidates in the finer cells around the ends of intervals that reach into a dense tick.

    ``rows``: entity, tick, s, e, interval, name. An end makes ``FINER`` cells a depth; in the one that
    holds it the candidate is left to the next depth."""
    widths = _finer_widths(tick_ms)
    begin = F.col("tick") * tick_ms
    cells = []
    for depth, width in enumerate(widths[1:], 1):
        for end in ("s", "e"):
            parent = _cell(F.col(end), tick_ms, depth - 1)
            last = F.least(parent + widths[depth - 1], begin + tick_ms) - 1
            own = _children(parent, last, depth, width)
            inside = F.col(end).between(begin, begin + tick_ms - 1)
            cells.append(F.when(inside, own))
    spread = rows.withColumn("_c", F.explode(F.array_distinct(F.flatten(F.filter(F.array(*cells), lambda c: c.isNotNull()))))).select(
        "entity", "_c.level", "_c.tick", "_c.high", "s", "e", "interval", "name"
    )
    return _placed(spread, F.col("tick"), F.col("high"), F.lit(None)).where("slot is not null")


def nearest_interval(events: DataFrame, intervals: DataFrame, *, within_ms: int = 5_000, tick_ms: int = 4_096) -> DataFrame:
    """Columns event, entity_name, interval, distance_ms of each event that has a match.

    ``events``: event (any type), entity, at_ms. ``intervals``: entity,
    entity_name, s, e (ms, s < e), interval (integer). Distance is 0 from s to
    e, otherwise to the closer end, at most ``within_ms``. Equally near: the
    greatest start, then the smallest interval id.

    Runs one small job over ``intervals`` while the plan is built (longest
    interval, densest tick).

    Defined results: events or intervals with a null entity or time match
    nothing; events without a match are left out; repeated rows of either side
    change nothing; empty tables give no rows; other columns are ignored.
    """
    # a name travels only where it isn't the entity itself
    name = F.when(F.col("entity_name") != F.col("entity"), F.col("entity_name"))
    right = intervals.where("entity is not null and s < e").select("entity", "s", "e", "interval", name.alias("name"))
    levels, dense = _shape(right, tick_ms)
    exploded = right.select("*", F.explode(_all_ticks(levels, tick_ms, within_ms)).alias("_t")).select("*", "_t.level", "_t.tick")
    low = F.col("tick") * tick_ms
    high = low + (tick_ms - 1)
    pair = (F.greatest("s", low) - low) * tick_ms + F.least("e", high) - low
    fine = F.col("level") == 0
    over = F.struct(F.lit(0).cast("bigint").alias("near"), F.col("s"), (-F.col("interval")).alias("low_id"), F.col("name"))
    base = exploded.where(fine)
    fine_rows = base if not dense else base.join(
        _ends(right, tick_ms).agg(F.count("*").alias("_n")).where(F.col("_n") > DENSE).select("entity", "tick", F.lit(True).alias("_dense")),
        ["entity", "tick"], "left",
    )
    placed = _placed(fine_rows, low, high, F.when(F.col("_dense"), F.lit(None)).otherwise(pair) if dense else pair).where("slot is not null")
    parts = [placed]
    if levels:
        parts.append(exploded.where(~fine).select("entity", "level", "tick", F.lit(OVER).cast("bigint").alias("slot"), over.alias("best")))
    if dense:
        parts.append(_dense_cells(fine_rows.where("_dense"), tick_ms))
    every = reduce(DataFrame.unionByName, parts)
    candidates = every.groupBy("entity", "level", "tick", "slot").agg(F.max("best").alias("best"))

    wanted = events.select("event", "entity", "at_ms").where("entity is not null and at_ms is not null").distinct()
    places = [(n, F.floor(F.col("at_ms") / (tick_ms * COARSER**n)).cast("bigint")) for n in range(levels + 1)]
    if dense:
        places += [(-depth, _cell(F.col("at_ms"), tick_ms, depth)) for depth in range(1, len(_finer_widths(tick_ms)))]
    ticks = F.array(*(F.struct(F.lit(n).alias("level"), tick.alias("tick")) for n, tick in places))
    asked = wanted.select("entity", "at_ms").distinct().select("entity", "at_ms", F.explode(ticks).alias("_t")).select("entity", "at_ms", "_t.level", "_t.tick")
    end = (
        F.when(F.col("slot") == BEFORE, F.col("best.near"))
        .when(F.col("slot") < 0, F.col("at_ms"))
        .otherwise(low + F.pmod(F.col("slot"), F.lit(tick_ms).cast("bigint")))
    )
    distance = F.greatest(F.col("best.s") - F.col("at_ms"), F.col("at_ms") - end, F.lit(0).cast("bigint"))
    found = (
        asked.join(candidates, ["entity", "level", "tick"])
        .withColumn("distance", distance)
        .where(F.col("distance") <= within_ms)
        # the join's partitioning serves this grouping
        .groupBy("entity", "level", "tick", "at_ms")
        .agg(F.max(F.struct((-F.col("distance")).alias("near"), "best.s", "best.low_id", "best.name")).alias("best"))
    )
    if levels or dense:
        found = found.groupBy("entity", "at_ms").agg(F.max("best").alias("best"))
        matched = wanted.join(found, ["entity", "at_ms"])
    else:
        placed_events = wanted.withColumns({"level": F.lit(0), "tick": places[0][1]})
        matched = placed_events.join(found, ["entity", "level", "tick", "at_ms"])
    return matched.select(
        "event",
        F.coalesce("best.name", "entity").alias("entity_name"),
        (-F.col("best.low_id")).alias("interval"),
        (-F.col("best.near")).alias("distance_ms"),
    )


def events_near_speech(ocr_event: DataFrame, utterance: DataFrame, *, within_ms: int = 5_000, tick_ms: int = 4_096) -> DataFrame:
    """event_id, video_id (as in ``utterance``), utt_id and distance_ms of each OCR event near speech."""
    events = ocr_event.select(
        F.col("event_id").alias("event"), media_key(F.col("video_id")).alias("entity"), to_ms(F.col("ts")).alias("at_ms")
    )
    spoken = utterance.select(
        media_key(F.col("video_id")).alias("entity"),
        F.col("video_id").alias("entity_name"),
        to_ms(F.col("start_sec")).alias("s"),
        to_ms(F.col("end_sec")).alias("e"),
        F.col("utt_id").alias("interval"),
    )
    found = nearest_interval(events, spoken, within_ms=within_ms, tick_ms=tick_ms)
    return found.select(
        F.col("event").alias("event_id"),
        F.col("entity_name").alias("video_id"),
        F.col("interval").cast(utterance.schema["utt_id"].dataType).alias("utt_id"),
        "distance_ms",
    )
