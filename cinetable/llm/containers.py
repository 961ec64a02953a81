"""Packing of documents into containers of a fixed number of tokens.

Method: Karmarkar-Karp multiway differencing. Partial partitions, one sum per
container, are merged in the order of their imbalance, the fullest container of
one with the emptiest of the other, which leaves near-equal containers; while
one of them exceeds the capacity the number of containers rises.

Packing is global only in how many containers it needs, so items are dealt by a
hash of their row into groups of about ``CONTAINERS_PER_GROUP`` containers and
at most about ``ITEMS_PER_GROUP`` items; each group is packed on its own and
loses at most part of one container. No key decides a group, so none is hot.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinetable.llm.tokens import encode_column
from cinetable.plans.columns import col
from cinetable.plans.lineage import materialise

CAPACITY = 4096
CONTAINERS_PER_GROUP = 128
ITEMS_PER_GROUP = 20_000


def differencing(sizes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiway Karmarkar-Karp: the container of each item and the containers' sums."""
    items = len(sizes)
    if count == 1:
        return np.zeros(items, dtype=np.int64), np.array([sizes.sum()])
    # a partial partition: its sums in falling order; nodes below ``items`` are single items
    sums: dict[int, np.ndarray] = {}
    heap = [(-int(size), node) for node, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []

    def vector(node: int) -> np.ndarray:
        if node >= items:
            return sums.pop(node)
        single = np.zeros(count, dtype=np.int64)
        single[0] = sizes[node]
        return single

    for node in range(items, 2 * items - 1):
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = vector(a) + vector(b)[::-1]
        order = np.argsort(-joined, kind="stable")
        joined = joined[order]
        merges.append((a, b, order.astype(np.int32)))
        sums[node] = joined
        heapq.heappush(heap, (-int(joined[0] - joined[-1]), node))
    root = 2 * items - 2
    place = np.zeros(items, dtype=np.int64)
    if items == 1:
        return place, vector(0)
    final = sums[root]
    # from the root down: which final container each slot of a partial partition became
    became: dict[int, np.ndarray] = {root: np.arange(count)}
    for node in range(root, items - 1, -1):
        a, b, order = merges[node - items]
        to = became.pop(node)
        slots = np.empty(count, dtype=np.int64)
        slots[order] = to
        for child, way in ((a, slots), (b, slots[::-1])):
            if child < items:
                place[child] = way[0]
            else:
                became[child] = way
    return place, final


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; the count rises until none exceeds the capacity. No item may exceed it."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    halves = int((sizes * 2 > capacity).sum())
    count = max(1, -(-int(sizes.sum()) // capacity), halves)
    while True:
        place, sums = differencing(sizes, count)
        over = int(np.maximum(sums - capacity, 0).sum())
        if not over:
            return place
        count += max(1, over // capacity)


def fill_containers(sized: DataFrame, key: str, size: str, *, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``key``, piece, piece_start, piece_end (of the item, in units), container.

    An item within the capacity is one piece (number 0). A larger one is cut
    into full pieces, each a container of its own, and a rest that is packed
    like an item. No container's pieces add up to more than ``capacity``.

    Defined results: a null or negative size counts as 0; items of size 0 are
    packed too, so every row comes out; repeated rows and null keys are items of
    their own; an empty table gives no rows; other columns are ignored.
    """
    rows = materialise(
        sized.select(col(key).alias("_key"), F.greatest(F.coalesce(col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("_size"))
    ).withColumn("_row", F.monotonically_increasing_id())
    rest = F.when(F.col("_size") > capacity, F.col("_size") % capacity).otherwise(F.col("_size"))
    total, items = rows.agg(F.coalesce(F.sum(rest), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-int(total) // (capacity * CONTAINERS_PER_GROUP)), -(-int(items) // ITEMS_PER_GROUP))

    whole = F.when(F.col("_size") > capacity, F.floor(F.col("_size") / capacity)).otherwise(0).cast("int")
    loose = rows.select(
        "_key",
        "_row",
        F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group"),
        whole.alias("piece"),
        F.col("_size").alias("_size"),
        rest.alias("_rest"),
    ).where(f"_rest > 0 or _size <= {capacity}")
    key_type = rows.schema["_key"].dataType.simpleString()

    def pack_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_row", kind="stable")
        place = pack(group["_rest"].to_numpy(dtype=np.int64), capacity)
        return pd.DataFrame(
            {
                "_key": group["_key"],
                "piece": group["piece"],
                "piece_start": group["_size"] - group["_rest"],
                "piece_end": group["_size"],
                "container": [f"{g}.{p}" for g, p in zip(group["_group"], place)],
            }
        )

    packed = loose.groupBy("_group").applyInPandas(
        pack_group, f"_key {key_type}, piece int, piece_start bigint, piece_end bigint, container string"
    )
    full = rows.where(F.col("_size") > capacity).select(
        "_key", "_row", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece")
    ).select(
        "_key",
        "piece",
        (F.col("piece").cast("bigint") * capacity).alias("piece_start"),
        ((F.col("piece").cast("bigint") + 1) * capacity).alias("piece_end"),
        F.concat_ws(".", F.lit("full"), "_row", "piece").alias("container"),
    )
    return packed.unionByName(full).withColumnRenamed("_key", key)


def pack_documents(documents: DataFrame, *, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """doc_id, piece, piece_start, piece_end (tokens of the document) and container of all documents."""
    sized = encode_column(documents.select("doc_id", "text"), "text", counts_only=True, folder=folder)
    return fill_containers(sized, "doc_id", "n_tokens", capacity=capacity)
