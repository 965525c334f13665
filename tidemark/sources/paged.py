"""Paged catalogs as data sources: one partition for each page in batch, a high-water mark as the stream's offset.

The source reads pages from a folder of recorded responses (``path``), or over HTTP from ``url`` with
``limit`` and ``offset`` parameters. A response is ``{"results": [...], "resultSetSize": n}``; results are in
descending order of ``updatedAt``, so a poll stops at the first page that reaches what is known.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "page int, position int, id string, updated_at string, record string"


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)


class Pages:
    """Where pages come from; made anew in each task from the options."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.url = options.get("path"), options.get("url")
        self.limit = int(options.get("limit", "1000"))
        if not (self.path or self.url):
            raise ValueError("a paged catalog needs a path or a url")

    def fetch(self, number: int) -> dict:
        if self.path:
            from pyarrow import fs

            system, folder = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
            name = f"{folder}/page-{number:05d}.json"
            if system.get_file_info(name).type == fs.FileType.NotFound:
                return {"results": [], "resultSetSize": 0}
            with system.open_input_file(name) as source:
                return json.loads(source.read())
        glue = "&" if "?" in self.url else "?"
        with urllib.request.urlopen(f"{self.url}{glue}limit={self.limit}&offset={number * self.limit}", timeout=60) as answer:  # noqa: S310
            return json.loads(answer.read())

    def count(self) -> int:
        first = self.fetch(0)
        return max(1, -(-int(first.get("resultSetSize", 0)) // self.limit))

    def rows(self, number: int, after: str | None = None) -> Iterator[tuple]:
        for position, record in enumerate(self.fetch(number).get("results", [])):
            resource = record.get("resource", {})
            updated = resource.get("updatedAt")
            if after is None or (updated or "") > after:
                yield number, position, resource.get("id"), updated, json.dumps(record)

    def newer(self, after: str) -> Iterator[tuple]:
        """Records after a high-water mark; the first page that reaches it is the last one fetched."""
        number = 0
        while True:
            records = self.fetch(number).get("results", [])
            yield from self.rows(number, after)
            if not records or min((r.get("resource", {}).get("updatedAt") or "") for r in records) <= after:
                return
            number += 1


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [Page(i) for i in range(Pages(self.options).count())]

    def read(self, partition: Page) -> Iterator[tuple]:
        return Pages(self.options).rows(partition.value)


class PagedStreamReader(SimpleDataSourceStreamReader):
    """Polls from the high-water mark that the offset holds; an empty poll leaves it where it was."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"hwm": self.options.get("after", "")}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(Pages(self.options).newer(start["hwm"]))
        return iter(rows), {"hwm": max([start["hwm"], *(r[3] or "" for r in rows)])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return (r for r in Pages(self.options).newer(start["hwm"]) if (r[3] or "") <= end["hwm"])


class PagedCatalog(DataSource):
    """``spark.read.format("paged_catalog").option("path", ...)``, or ``readStream`` for what is new."""

    @classmethod
    def name(cls) -> str:
        return "paged_catalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema: object) -> SimpleDataSourceStreamReader:
        return PagedStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedCatalog)


__all__ = ["DataSourceStreamReader", "PagedCatalog", "register"]
