"""Filling containers of fixed capacity: first-fit decreasing (problem 8).

Items are dealt into groups of bounded size by a hash of their id, and each
group is packed by itself: longest first, each item into the first container
with room.  That container is found in a tournament tree, whose nodes hold the
most room of any container below, in as many steps as the tree is high.  A group
leaves about one container partly empty, so groups are large.

Defined results: an item longer than a container is split into full containers
and a rest, which is packed like an item; an item of length 0 takes a place but
no room; a null length counts as 0; null ids are items like any other; equal
lengths are packed in order of id; no items give no containers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one group, on average.
GROUP_ITEMS = 40_000


def first_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, taken in the given order, each into the first one with room."""
    n = len(sizes)
    if not n:
        return np.empty(0, np.int64)
    leaves = 1 << (n - 1).bit_length()
    # room[k] is the most room below node k; the leaves are the containers, all empty, so at most one per item is used
    room = [capacity] * (2 * leaves)
    placed = []
    for size in sizes.tolist():
        k = 1
        while k < leaves:
            k += k
            if room[k] < size:
                k += 1
        placed.append(k - leaves)
        if not size:
            continue
        room[k] -= size
        k >>= 1
        while k:
            a, b = room[2 * k], room[2 * k + 1]
            most = a if a > b else b
            if room[k] == most:
                break
            room[k] = most
            k >>= 1
    return np.asarray(placed, np.int64)


PLACED = pa.schema(
    [
        ("limit_id", pa.int32()),
        ("capacity", pa.int32()),
        ("container", pa.int64()),
        ("doc_id", pa.int64()),
        ("piece", pa.int64()),
        ("first_token", pa.int64()),
        ("n_tokens", pa.int64()),
    ]
)
PLACED_DDL = "limit_id int, capacity int, container bigint, doc_id bigint, piece bigint, first_token bigint, n_tokens bigint"


def pack_group(limit: int, capacity: int, group: int, items: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Index of the item, piece, first token, tokens and container of every piece of one group."""
    full, rest = sizes // capacity, sizes % capacity
    full = np.where(sizes <= capacity, 0, full)
    rest = np.where(sizes <= capacity, sizes, rest)
    n_full = int(full.sum())
    whole = np.repeat(np.arange(len(sizes)), full)
    piece_of_whole = np.arange(n_full) - np.repeat(np.cumsum(full) - full, full)
    kept = np.flatnonzero((rest > 0) | (full == 0))
    order = kept[np.lexsort((items[kept], -rest[kept]))]
    containers = first_fit(rest[order], capacity) + n_full
    index = np.concatenate([whole, order])
    piece = np.concatenate([piece_of_whole, full[order]])
    return {
        "index": index,
        "piece": piece,
        "first_token": piece * capacity,
        "n_tokens": np.concatenate([np.full(n_full, capacity, np.int64), rest[order]]),
        "container": (np.int64(group) << 32) + np.concatenate([np.arange(n_full), containers]),
    }


def _packed(key: tuple, table: pa.Table) -> pa.Table:
    limit, capacity, group = (k.as_py() for k in key)
    items = table["doc_id"].combine_chunks()
    done = pack_group(limit, capacity, group, items.fill_null(-(1 << 63)).to_numpy(), table["n_tokens"].to_numpy())
    n = len(done["index"])
    return pa.table(
        [
            pa.array(np.full(n, limit, np.int32)),
            pa.array(np.full(n, capacity, np.int32)),
            pa.array(done["container"]),
            items.take(pa.array(done["index"])),
            pa.array(done["piece"]),
            pa.array(done["first_token"]),
            pa.array(done["n_tokens"]),
        ],
        schema=PLACED,
    )


def pack(items: DataFrame, n_items: int, group_items: int = GROUP_ITEMS, seed: int = 7) -> DataFrame:
    """Rows ``limit_id, capacity, container, doc_id, piece, first_token, n_tokens`` of ``limit_id, capacity, doc_id, n_tokens``.

    ``n_items`` is the number of items of one limit; containers are numbered within their limit.
    """
    groups = max(1, -(-n_items // group_items))
    # items without an id are dealt out by their place
    own = F.coalesce(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id())
    dealt = items.select(
        F.col("limit_id").cast("int").alias("limit_id"),
        F.col("capacity").cast("int").alias("capacity"),
        F.pmod(F.xxhash64(own, F.lit(seed)), F.lit(groups)).cast("int").alias("grp"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0).cast("bigint")).alias("n_tokens"),
    )
    return dealt.groupBy("limit_id", "capacity", "grp").applyInArrow(_packed, PLACED_DDL)
