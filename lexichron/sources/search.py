"""A paged REST search as a Spark data source.

Off by default: it does nothing without a fetcher, a function of (query, start,
count) that returns one page as JSON text.  One partition reads one page, and a
page that fails is read again by Spark's retry.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, int, int], str]


def any_of(phrases: list[str]) -> str:
    """A query for any of the phrases."""
    return " OR ".join(f'("{p}")' for p in phrases)


def page_starts(total: int, page: int) -> list[int]:
    return list(range(0, total, page))


class _Page(InputPartition):
    def __init__(self, start: int):
        self.start = start


def search_source(fetch: Fetch, name: str = "paged_search") -> type[DataSource]:
    """The data source class of a fetcher; register it with ``spark.dataSource.register``."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.query, self.page = options["query"], int(options.get("page", "25"))

        def partitions(self) -> list[InputPartition]:
            first = json.loads(fetch(self.query, 0, 1))["search-results"]
            return [_Page(s) for s in page_starts(int(first["opensearch:totalResults"]), self.page)]

        def read(self, partition: _Page) -> Iterator[tuple]:
            found = json.loads(fetch(self.query, partition.start, self.page))["search-results"].get("entry", [])
            for k, entry in enumerate(found):
                yield partition.start + k, json.dumps(entry)

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "entry_id bigint, payload string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Search


def hit_counts(spark: SparkSession, phrases: list[str], fields: list[str], fetch: Fetch) -> DataFrame:
    """``phrase, field, hits``: one request for each phrase and field; both are lists of settings."""
    rows = [(p, f, int(json.loads(fetch(f'{f}("{p}")', 0, 1))["search-results"]["opensearch:totalResults"])) for p in phrases for f in fields]
    return spark.createDataFrame(rows, "phrase string, field string, hits bigint")
