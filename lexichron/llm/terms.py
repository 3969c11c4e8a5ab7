"""Counted terms: from the n-gram dictionary to one row per record and term.

Of the rows with the same ``id_kase`` and ``ngram`` only the latest by
``loaded_at`` counts, and only if its lemmata are not blank and its count is
above 0.  Lemmata are written trimmed, in lower case, in Unicode's NFKC.

Defined results: rows without ``id_kase`` belong to no record and are left out;
a null ``ngram`` is a key like any other; a null ``loaded_at`` is earlier than
any time; of rows equally late the one with the greater term, then the greater
count stands (nulls are smallest); an empty table gives no rows.  Other columns
are ignored.

Partitioning: one shuffle by ``id_kase`` serves both the choice of the latest
row and the sum per term, and what follows by record.  Records with more rows
than ``hot_rows`` would make a huge partition; they are found beforehand by a
count over that one column and go another way, grouped by all keys with a combine
on the map side.  Where more than ``hot_most`` records are hot, all rows go that
way, so the list of hot records has a bound and no record a partition to itself.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Rows of one record from which it is treated as hot, and the most hot records that are listed.
HOT_ROWS = 200_000
HOT_MOST = 2_000


def normal_form(text: str) -> str:
    """The written form of a lemma: NFKC, lower case, trimmed."""
    lowered = unicodedata.normalize("NFKC", text).lower()
    return unicodedata.normalize("NFKC", lowered).strip()


def normal_forms(values: pa.Array) -> pa.Array:
    """``normal_form`` of each value; null and blank ones become null. Only what isn't ASCII is done one by one."""
    values = values.cast(pa.string())
    ascii_only = pc.string_is_ascii(values)
    if pc.all(ascii_only, min_count=0).as_py():
        done = pc.ascii_trim_whitespace(pc.ascii_lower(values))
    else:
        flags = ascii_only.to_pylist()
        quick = pc.ascii_trim_whitespace(pc.ascii_lower(pc.if_else(ascii_only, values, ""))).to_pylist()
        done = pa.array(
            [q if f else (None if f is None else normal_form(v)) for q, f, v in zip(quick, flags, values.to_pylist())],
            pa.string(),
        )
    return pc.if_else(pc.equal(done, ""), pa.scalar(None, pa.string()), done)


@F.arrow_udf(StringType())
def written_form(values: pa.Array) -> pa.Array:
    return normal_forms(values)


def _latest_then_summed(rows: DataFrame) -> DataFrame:
    latest = rows.groupBy("id_kase", "ngram").agg(F.max(F.struct("loaded_at", "term", "count")).alias("r"))
    return (
        latest.select("id_kase", F.col("r.term").alias("term"), F.col("r.count").alias("n"))
        .filter((F.col("n") > 0) & F.col("term").isNotNull())
        .groupBy("id_kase", "term")
        .agg(F.sum("n").alias("n"))
    )


def counted_terms(dictionary: DataFrame, hot_rows: int = HOT_ROWS, hot_most: int = HOT_MOST) -> DataFrame:
    """``id_kase, term, n``: one row per record and term, partitioned by ``id_kase`` but for hot records."""
    rows = dictionary.select("id_kase", "ngram", "lemmata", "count", "loaded_at").filter(F.col("id_kase").isNotNull())
    crowded = rows.groupBy("id_kase").count().filter(F.col("count") > hot_rows)
    hot = [r[0] for r in crowded.select("id_kase").limit(hot_most + 1).collect()]

    def with_term(part: DataFrame) -> DataFrame:
        return part.select("id_kase", "ngram", written_form("lemmata").alias("term"), "count", "loaded_at")

    if not hot:
        return _latest_then_summed(with_term(rows).repartition("id_kase"))
    if len(hot) > hot_most:
        return _latest_then_summed(with_term(rows))
    is_hot = F.col("id_kase").isin(hot)
    usual = _latest_then_summed(with_term(rows.filter(~is_hot)).repartition("id_kase"))
    return usual.unionByName(_latest_then_summed(with_term(rows.filter(is_hot))))
