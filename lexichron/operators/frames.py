"""Small things about frames: their shape, columns by pattern, maps, strict lookups, rows drawn at random."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexichron.operators.numbering import numbered


def shape(df: DataFrame) -> tuple[int, int]:
    """Rows and columns."""
    return df.count(), len(df.columns)


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """The columns whose whole name matches a pattern, in their order."""
    return [c for c in df.columns if re.fullmatch(pattern, c)]


def as_map(key: Column | str, value: Column | str) -> Column:
    """Two columns of a group as one map; null keys are left out, of equal keys the greatest value stands."""
    key, value = (F.col(x) if isinstance(x, str) else x for x in (key, value))
    pairs = F.array_sort(F.collect_list(F.when(key.isNotNull(), F.struct(key.alias("k"), value.alias("v")))))
    last = F.filter(pairs, lambda p, i: F.coalesce(p["k"] != F.get(pairs, i + 1)["k"], F.lit(True)))
    return F.map_from_entries(last)


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join for which every key of ``left`` must be in ``right``; KeyError with a few of those that are not."""
    missing = [r[0] for r in left.select(key).join(right.select(key), key, "left_anti").distinct().limit(5).collect()]
    if missing:
        raise KeyError(f"{key}: {missing}")
    return left.join(right, key)


def random_rows(df: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` rows drawn without replacement (all if there are fewer), the same for every partitioning; equal rows are drawn alike."""
    return df.orderBy(F.xxhash64(*df.columns, F.lit(seed)), *[c for c, kind in df.dtypes if not kind.startswith("map")]).limit(k)


def draw_rows(df: DataFrame, k: int, seed: int, order: list[str]) -> DataFrame:
    """Exactly ``k`` rows drawn with replacement, each as likely as any other, the same for every partitioning; none of an empty table."""
    placed = numbered(df, order, "_row")
    total = placed.count()
    if not total:
        return df.limit(0)
    drawn = df.sparkSession.range(k).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("_row"))
    return drawn.join(placed, "_row").drop("_row")
