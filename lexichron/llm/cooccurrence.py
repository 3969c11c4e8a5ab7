"""Items that appear together: heavy-light decomposition (problem 2).

Within each group of records, items below the support that any accepted pair
needs are left out first; as ab <= min(a, b), that loses no pair.  The others
are numbered by falling frequency.  Records are dealt into blocks of bounded
size by a hash, and each block counts all of its pairs:

* heavy x heavy: a dense bit matrix, one row of bits per item; a pair's count is
  the popcount of the AND of two rows;
* heavy x light: the list of records of each light item probes the heavy bits of
  those records;
* light x light: pairs are hash-counted, record by record.

Blocks send one count per pair that they hold; the counts are added up and
scored.  A group that holds a third of all records is simply many blocks, and
no group or record is ever collected whole but for its frequent items.

Defined results: a record counts an item once, however often it is given; null
records, groups and items are left out; an empty table gives no pairs; ties and
repeated rows change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexichron.operators.numbering import numbered
from lexichron.session import written

#: Records of one block, and the share of a group's records from which an item is heavy.
BLOCK_RECORDS = 32_768
HEAVY_SHARE = 1 / 12
#: Items (over all groups) up to which their numbering is broadcast; beyond it the encoding is a shuffled join.
BROADCAST_ITEMS = 500_000

PAIRS = pa.schema([("grp", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("both", pa.int64())])


def heavy_heavy(bits: np.ndarray) -> np.ndarray:
    """Counts of all pairs of rows of a packed bit matrix (items x words): popcounts of ANDs; upper triangle."""
    items = len(bits)
    counts = np.zeros((items, items), np.int64)
    for i in range(items - 1):
        counts[i, i + 1 :] = np.bitwise_count(bits[i + 1 :] & bits[i]).sum(axis=1, dtype=np.int64)
    return counts


def heavy_light(bits: np.ndarray, heavy: int, records: np.ndarray, light: np.ndarray, lights: int) -> np.ndarray:
    """Counts lights x heavy: the list of each light item probes the heavy bits of its records.

    ``records`` and ``light`` are the light occurrences, in order of ``light``.
    """
    counts = np.zeros((lights, heavy), np.int64)
    by_record = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")
    for at in range(0, len(light), 16_384):
        some, which = light[at : at + 16_384], records[at : at + 16_384]
        starts = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
        counts[some[starts]] += np.add.reduceat(by_record[:, which], starts, axis=1, dtype=np.int64).T
    return counts


def light_light(records: np.ndarray, light: np.ndarray, lights: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair keys (i * lights + j, i < j) and counts; the occurrences are in order of record, then item."""
    keys, counts, waiting, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def combined():
        each, n = np.unique(np.concatenate(waiting), return_counts=True)
        every, where = np.unique(np.concatenate([keys, each]), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, where, np.concatenate([counts, n]))
        return every, total

    left = np.arange(len(light))
    step = 1
    while len(left):
        left = left[left + step < len(light)]
        left = left[records[left] == records[left + step]]
        if not len(left):
            break
        waiting.append(light[left].astype(np.int64) * lights + light[left + step])
        held += len(left)
        if held > 4_000_000:
            keys, counts = combined()
            waiting, held = [], 0
        step += 1
    if waiting:
        keys, counts = combined()
    return keys, counts


def block_pairs(group: str, records: np.ndarray, items: np.ndarray, heavy: int) -> pa.Table:
    """All pairs of one block with their counts. Items below ``heavy`` are heavy."""
    order = np.lexsort((items, records))
    records, items = records[order], items[order]
    keep = np.r_[True, (records[1:] != records[:-1]) | (items[1:] != items[:-1])] if len(items) else np.empty(0, bool)
    _, records = np.unique(records[keep], return_inverse=True)
    items = items[keep]
    n_records = int(records.max()) + 1 if len(records) else 0
    is_heavy = items < heavy
    words = (n_records + 63) // 64
    dense = np.zeros((heavy, words * 64), np.uint8)
    dense[items[is_heavy], records[is_heavy]] = 1
    bits = np.packbits(dense, axis=1, bitorder="little").view(np.uint64) if words else np.zeros((heavy, 0), np.uint64)
    del dense
    found = []
    if heavy > 1 and words:
        both = heavy_heavy(bits)
        i, j = np.nonzero(both)
        found.append((i, j, both[i, j]))
    light_items, light_records = items[~is_heavy] - heavy, records[~is_heavy]
    if len(light_items):
        lights = int(light_items.max()) + 1
        if heavy:
            by_item = np.argsort(light_items, kind="stable")
            both = heavy_light(bits, heavy, light_records[by_item], light_items[by_item], lights)
            j, i = np.nonzero(both)
            found.append((i, j + heavy, both[j, i]))
        keys, both = light_light(light_records, light_items, lights)
        found.append((keys // lights + heavy, keys % lights + heavy, both))
    if not found:
        return PAIRS.empty_table()
    i, j, both = (np.concatenate([f[k] for f in found]) for k in range(3))
    return pa.table(
        [pa.array([group] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(both)],
        schema=PAIRS,
    )


def _count_block(key: tuple, block: pa.Table) -> pa.Table:
    records = block["record"].combine_chunks().dictionary_encode().indices  # records may be keys of any kind
    return block_pairs(key[0].as_py(), records.to_numpy(), block["item"].to_numpy(), int(block["heavy"][0].as_py()))


def cooccurring(
    rows: DataFrame,
    min_count: int = 5,
    min_share: float = 0.0,
    min_lift: float = 0.0,
    block_records: int = BLOCK_RECORDS,
    heavy_share: float = HEAVY_SHARE,
) -> DataFrame:
    """Pairs of items of the same record, of rows ``grp, record, item``, one per record and item.

    Returns ``grp, item_a, item_b, records, n_a, n_b, n_both, lift`` for pairs
    item_a < item_b with n_both >= min_count, n_both >= min_share * records and
    n_both * records >= min_lift * n_a * n_b, where ``records`` are the group's.
    The thresholds are the result's definition; every pair that meets them is found.
    """
    rows = rows.filter("grp is not null and record is not null and item is not null").select("grp", "record", "item")
    sizes = rows.groupBy("grp").agg(F.countDistinct("record").alias("records"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("records") / block_records)).withColumn(
        "least", F.greatest(F.lit(min_count), F.ceil(F.col("records") * min_share - 1e-9)).cast("bigint")
    )
    supported = rows.groupBy("grp", "item").agg(F.count("*").alias("n")).join(sizes, "grp").filter("n >= least")
    # numbered over all groups in order, so no group's items meet in one task
    placed = numbered(supported.withColumn("fewer", -F.col("n")), ["grp", "fewer", "item"], "place")
    begins = placed.groupBy("grp").agg(
        F.min("place").alias("begin"), F.count_if(F.col("n") >= F.col("records") * heavy_share).cast("int").alias("heavy")
    )
    items = written(placed.join(begins, "grp").withColumn("idx", (F.col("place") - F.col("begin")).cast("int")), "items")
    few = items.count() <= BROADCAST_ITEMS
    hint = F.broadcast if few else (lambda df: df)
    encoded = rows.join(hint(items.select("grp", "item", "idx", "heavy", "blocks")), ["grp", "item"]).select(
        "grp",
        F.expr("cast(pmod(xxhash64(record), blocks) as int)").alias("block"),
        "record",
        F.col("idx").alias("item"),
        "heavy",
    )
    counted = encoded.groupBy("grp", "block").applyInArrow(_count_block, "grp string, i int, j int, `both` bigint")
    added = counted.groupBy("grp", "i", "j").agg(F.sum("both").alias("n_both"))
    a = items.select("grp", F.col("idx").alias("i"), F.col("item").alias("x"), F.col("n").alias("n_x"), "records", "least")
    b = items.select("grp", F.col("idx").alias("j"), F.col("item").alias("y"), F.col("n").alias("n_y"))
    scored = added.filter(F.col("n_both") >= min_count).join(hint(a), ["grp", "i"]).filter("n_both >= least").join(hint(b), ["grp", "j"])
    swap = F.col("x") > F.col("y")
    lift = F.col("n_both") * F.col("records") / (F.col("n_x") * F.col("n_y"))
    return scored.filter(
        F.col("n_both").cast("double") * F.col("records") >= F.lit(float(min_lift)) * F.col("n_x") * F.col("n_y")
    ).select(
        "grp",
        F.when(swap, F.col("y")).otherwise(F.col("x")).alias("item_a"),
        F.when(swap, F.col("x")).otherwise(F.col("y")).alias("item_b"),
        "records",
        F.when(swap, F.col("n_y")).otherwise(F.col("n_x")).alias("n_a"),
        F.when(swap, F.col("n_x")).otherwise(F.col("n_y")).alias("n_b"),
        "n_both",
        lift.alias("lift"),
    )
