"""A paged source as a Spark data source: a partition for each page, over any fetcher."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: (offset, length) -> (rows as mappings, number of all rows).
Fetch = Callable[[int, int], tuple[list[dict], int]]
PAGE, ATTEMPTS = 100, 3


class PageRange(InputPartition):
    def __init__(self, offset: int, length: int):
        super().__init__(offset)
        self.offset, self.length = offset, length


class _Pages(DataSourceReader):
    def __init__(self, fetch: Fetch, names: list[str], page: int, most: int | None, attempts: int, pause: float):
        self.fetch, self.names, self.page, self.most, self.attempts, self.pause = fetch, names, page, most, attempts, pause

    def _fetched(self, offset: int, length: int) -> tuple[list[dict], int]:
        """A page that fails is asked for again, a little later each time."""
        for turn in range(1, self.attempts + 1):
            try:
                return self.fetch(offset, length)
            except Exception:
                if turn == self.attempts:
                    raise
                time.sleep(self.pause * turn)
        raise AssertionError

    def partitions(self) -> list[PageRange]:
        total = self._fetched(0, 1)[1]
        total = total if self.most is None else min(total, self.most)
        return [PageRange(at, min(self.page, total - at)) for at in range(0, total, self.page)] or [PageRange(0, 0)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        at, left = partition.offset, partition.length
        while left:  # a page may come in parts
            rows, _ = self._fetched(at, left)
            if not rows:
                return
            for row in rows[:left]:
                yield tuple(row.get(k) for k in self.names)
            at, left = at + len(rows[:left]), left - len(rows[:left])


def read_pages(
    spark: SparkSession, fetch: Fetch, schema: str, page: int = PAGE, most: int | None = None, attempts: int = ATTEMPTS, pause: float = 0.2, name: str = "pages"
) -> DataFrame:
    """All rows of a paged source, or the first ``most`` of them. ``schema`` is DDL; missing fields are null.

    Each page is fetched by a task of its own, and anew if that is lost; a page that fails ``attempts`` times fails the job."""
    names = StructType.fromDDL(schema).fieldNames()

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Pages(fetch, names, page, most, attempts, pause)

    spark.dataSource.register(Pages)
    return spark.read.format(name).load()
