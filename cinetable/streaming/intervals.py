"""Continuous periods of a stream of intervals, kept in keyed state.

The state of a key is its ordered map of disjoint intervals. Every batch inserts
the new intervals by binary search; the rows put out are the periods that are
new or have grown, so a consumer keeps the last row of each ``start_ms`` it
still covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cinetable.operators.interval_union import IntervalMap


def running_periods(stream: DataFrame, key: str) -> DataFrame:
    """``stream``: key (string), start_ms, end_ms. Result: key, start_ms, end_ms of the periods that changed.

    Null or reversed intervals are left out."""

    def update(ident: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        intervals = IntervalMap(*state.get) if state.exists else IntervalMap()
        before = set(zip(intervals.starts, intervals.ends))
        for part in parts:
            for start, end in zip(part["start_ms"], part["end_ms"]):
                if not pd.isna(start) and not pd.isna(end) and start < end:
                    intervals.insert(int(start), int(end))
        state.update((intervals.starts, intervals.ends))
        changed = [(ident[0], s, e) for s, e in zip(intervals.starts, intervals.ends) if (s, e) not in before]
        yield pd.DataFrame(changed, columns=[key, "start_ms", "end_ms"])

    return stream.select(key, "start_ms", "end_ms").groupBy(key).applyInPandasWithState(
        update,
        f"{key} string, start_ms bigint, end_ms bigint",
        "starts array<bigint>, ends array<bigint>",
        "update",
        GroupStateTimeout.NoTimeout,
    )
