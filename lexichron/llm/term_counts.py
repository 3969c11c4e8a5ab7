"""Frequency of every distinct term: burst-trie counting (problem 1).

Each worker inserts its terms into a burst trie: containers of suffixes that
burst into a trie node once they hold more than ``burst`` entries.  A trie holds
two counters per term, occurrences and records, and is emitted in compact form:
one row per container, its prefix and sorted suffixes with their counters.

A router then cuts the tries alike for all workers.  Prefixes under which all
workers together hold more than a fair share of entries are opened, and a term
is routed by its shortest prefix that isn't opened.  Prefixes are looked at
``DEPTH`` characters at a time, deeper only below those that are still too heavy,
so terms that share a long beginning are parted too; at most ``shares`` prefixes
of each length are opened, whatever the data, so the router is small.  The
subtrees of the same route meet in one task and are merged.  A term's rows are
combined in each worker before anything moves, so a term that holds a third of
all rows costs one entry per worker.

Defined results: a term is any non-null string, the empty one included; null
terms are left out; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexichron.session import shuffle_width, written

#: Entries from which a container bursts; distinct terms from which a worker emits its trie and begins another.
BURST = 512
TRIE_TERMS = 400_000
#: Rows combined at once before they are inserted.
COMBINE_ROWS = 200_000
#: Characters of prefixes that the router looks at in one pass.
DEPTH = 24

SUBTRIE = pa.schema(
    [
        ("prefix", pa.string()),
        ("suffixes", pa.list_(pa.string())),
        ("occurrences", pa.list_(pa.int64())),
        ("records", pa.list_(pa.int64())),
    ]
)
SUBTRIE_DDL = "prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"


class BurstTrie:
    """Terms with two counters.  A node maps a character to a node or a container; '' holds the term that ends there.

    ``Node`` and container are both dicts; a container is wrapped in a list, so that the two can't be mistaken.
    """

    __slots__ = ("burst", "root", "size")

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.root: dict = {}
        self.size = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, at, end = self.root, 0, len(term)
        while at < end:
            child = node.get(term[at])
            if child is None:
                node[term[at]] = [{term[at + 1 :]: [occurrences, records]}]
                self.size += 1
                return
            at += 1
            if type(child) is dict:
                node = child
                continue
            container, suffix = child[0], term[at:]
            held = container.get(suffix)
            if held is not None:
                held[0] += occurrences
                held[1] += records
                return
            container[suffix] = [occurrences, records]
            self.size += 1
            if len(container) > self.burst:
                node[term[at - 1]] = self._opened(container)
            return
        held = node.get("")
        if held is None:
            node[""] = ([occurrences, records],)
            self.size += 1
        else:
            held[0][0] += occurrences
            held[0][1] += records

    @staticmethod
    def _opened(container: dict) -> dict:
        node: dict = {}
        for suffix, counters in container.items():
            if suffix == "":
                node[""] = (counters,)
            elif suffix[0] in node:
                node[suffix[0]][0][suffix[1:]] = counters
            else:
                node[suffix[0]] = [{suffix[1:]: counters}]
        return node

    def subtries(self) -> Iterator[tuple[str, list[tuple[str, list[int]]]]]:
        """(prefix, sorted (suffix, counters)) of every container, depth first."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            for character, child in sorted(node.items(), reverse=True):
                if character == "":
                    yield prefix, [("", child[0])]
                elif type(child) is dict:
                    stack.append((prefix + character, child))
                else:
                    yield prefix + character, sorted(child[0].items())

    def merge(self, prefix: str, suffixes: list[str], occurrences: list[int], records: list[int]) -> None:
        """Adds a subtrie of another worker."""
        for suffix, o, r in zip(suffixes, occurrences, records):
            self.add(prefix + suffix, o, r)


def _emitted(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
    prefixes, suffixes, occurrences, records = [], [], [], []
    held = 0
    for prefix, entries in trie.subtries():
        prefixes.append(prefix)
        suffixes.append([s for s, _ in entries])
        occurrences.append([c[0] for _, c in entries])
        records.append([c[1] for _, c in entries])
        held += len(entries)
        if held > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((prefixes, suffixes, occurrences, records), SUBTRIE.types)], schema=SUBTRIE)
            prefixes, suffixes, occurrences, records, held = [], [], [], [], 0
    if prefixes:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((prefixes, suffixes, occurrences, records), SUBTRIE.types)], schema=SUBTRIE)


def _count_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns term, occurrences, records, in this order."""
    trie, waiting, rows = BurstTrie(), [], 0

    def insert() -> None:
        combined = (
            pa.Table.from_batches(waiting).rename_columns(["t", "o", "r"]).group_by("t").aggregate([("o", "sum"), ("r", "sum")])
        )
        for term, o, r in zip(combined["t"].to_pylist(), combined["o_sum"].to_pylist(), combined["r_sum"].to_pylist()):
            if term is not None:
                trie.add(term, o, r)

    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= COMBINE_ROWS:
            insert()
            waiting, rows = [], 0
            if trie.size >= TRIE_TERMS:
                yield from _emitted(trie)
                trie = BurstTrie()
    if waiting:
        insert()
    yield from _emitted(trie)


def opened_prefixes(subtries: DataFrame, shares: int, least: int = 20_000, depth: int = DEPTH) -> list[str]:
    """The prefixes that hold more than a fair share of all workers' entries: at most ``shares`` of each length."""
    weights = subtries.select("prefix", F.size("suffixes").alias("w")).groupBy("prefix").agg(F.sum("w").alias("w"))
    total = subtries.agg(F.coalesce(F.sum(F.size("suffixes")), F.lit(0))).first()[0]
    fair = max(total // shares, least)
    opened: list[str] = []
    shortest, below = 0, weights
    while True:
        longest = shortest + depth - 1
        each = F.expr(f"explode(transform(sequence({shortest}, least(length(prefix), {longest})), i -> substring(prefix, 1, i)))").alias("p")
        heavy = below.filter(F.length("prefix") >= shortest).select(each, "w").groupBy("p").agg(F.sum("w").alias("w")).filter(F.col("w") > fair)
        found = [r[0] for r in heavy.select("p").collect()]
        opened += found
        deepest = [p for p in found if len(p) == longest]
        if not deepest:
            return opened
        below, shortest = below.filter(F.substring("prefix", 1, longest).isin(deepest)), longest + 1


def _routed(opened: frozenset[str]):
    """Cuts subtries at the router's prefixes: adds the column ``route``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = SUBTRIE.insert(0, pa.field("route", pa.string()))
        for batch in batches:
            rows = []
            for prefix, suffixes, occurrences, records in zip(*(batch.column(i).to_pylist() for i in range(4))):
                at = 0
                while at < len(prefix) and prefix[:at] in opened:
                    at += 1
                if prefix[:at] not in opened:
                    rows.append((prefix[:at], prefix, suffixes, occurrences, records))
                    continue
                parts: dict[str, tuple[list, list, list]] = {}
                for suffix, o, r in zip(suffixes, occurrences, records):
                    term, to = prefix + suffix, at
                    while to < len(term) and term[:to] in opened:
                        to += 1
                    part = parts.setdefault(term[:to], ([], [], []))
                    for into, value in zip(part, (term[to:], o, r)):
                        into.append(value)
                rows += [(route, route, *part) for route, part in parts.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), t) for x, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema
            )

    return cut


COUNTED = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _merge(group: pa.Table) -> pa.Table:
    """All subtries of one route, merged into one trie, as rows."""
    trie = BurstTrie()
    for prefix, suffixes, occurrences, records in zip(*(group.column(c).to_pylist() for c in ("prefix", "suffixes", "occurrences", "records"))):
        trie.merge(prefix, suffixes, occurrences, records)
    terms, occurrences, records = [], [], []
    for prefix, entries in trie.subtries():
        for suffix, (o, r) in entries:
            terms.append(prefix + suffix)
            occurrences.append(o)
            records.append(r)
    return pa.Table.from_arrays([pa.array(terms, pa.string()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())], schema=COUNTED)


def term_counts(rows: DataFrame) -> DataFrame:
    """``term, occurrences, records`` of rows ``term, n``, one per record and term."""
    spark = rows.sparkSession
    local = rows.filter(F.col("term").isNotNull()).select("term", F.col("n").cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("r"))
    subtries = written(local.mapInArrow(_count_locally, SUBTRIE_DDL), "subtries")
    opened = frozenset(opened_prefixes(subtries, 4 * shuffle_width(spark)))
    routed = subtries.mapInArrow(_routed(opened), f"route string, {SUBTRIE_DDL}")
    return routed.groupBy("route").applyInArrow(_merge, "term string, occurrences bigint, records bigint")


def marked(counts: DataFrame, records: int, rare_below: int = 3, common_above: float = 0.25) -> DataFrame:
    """Adds ``mark``: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than that share of all, else null.

    A term that is both is rare.
    """
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * records, "common")
    return counts.withColumn("mark", mark)
