"""Scans as Python data sources: spark.read.format("millrace_urls").load(..) and the like, after registered()."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Slice(InputPartition):
    def __init__(self, rows: list[str]) -> None:
        self.rows = rows


class Fetching(DataSourceReader):
    """Fetches the URLs of the option urls (separated by white space), in so many partitions."""

    def __init__(self, options: dict[str, str]) -> None:
        self.urls = options.get("urls", "").split()
        self.slices = max(1, int(options.get("partitions", "8")))
        self.retries = int(options.get("retries", "3"))

    def partitions(self) -> list[Slice]:
        return [Slice(self.urls[i :: self.slices]) for i in range(self.slices) if self.urls[i :: self.slices]] or [Slice([])]

    def read(self, partition: Slice) -> Iterator[tuple]:
        from .files import http_get, outcome

        for url in partition.rows:
            yield outcome(url, http_get, self.retries)


class Pages(DataSource):
    """url, html, status and attempts of web pages."""

    @classmethod
    def name(cls) -> str:
        return "millrace_pages"

    def schema(self) -> str:
        return "url string, html string, status string, attempts int"

    def reader(self, schema) -> DataSourceReader:
        return Fetching(dict(self.options))


class Lines(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.rows = [x.strip() for x in options.get("text", "").split("\n")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from ((i, x) for i, x in enumerate(self.rows) if x and not x.startswith("#"))


class Urls(DataSource):
    """place and url of a list given as text: neither blank lines nor comments."""

    @classmethod
    def name(cls) -> str:
        return "millrace_urls"

    def schema(self) -> str:
        return "place bigint, url string"

    def reader(self, schema) -> DataSourceReader:
        return Lines(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    for source in (Pages, Urls):
        spark.dataSource.register(source)
    return spark
