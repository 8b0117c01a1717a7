"""Web pages as a Spark data source: ``spark.read.format("pages").option("urls", ...)``.

Every partition fetches its share of the addresses, so a list of any length is
read by all executors; a page that cannot be read is a row with an error, never
a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGENT, TIMEOUT, PER_PARTITION = "tidemark/1.0", 30.0, 16


class _Addresses(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = json.loads(options.get("urls", "[]"))
        self.agent = options.get("agent", AGENT)
        self.timeout = float(options.get("timeout", TIMEOUT))
        self.per = max(1, int(options.get("perpartition", PER_PARTITION)))

    def partitions(self) -> list[InputPartition]:
        return [_Addresses(self.urls[i : i + self.per]) for i in range(0, len(self.urls), self.per)] or [_Addresses([])]

    def read(self, partition: _Addresses) -> Iterator[tuple]:
        for url in partition.urls:
            try:
                with urlopen(Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as answer:  # noqa: S310
                    yield url, answer.read().decode("utf-8-sig", "replace"), None
            except (OSError, ValueError) as problem:
                yield url, None, f"{type(problem).__name__}: {problem}"[:200]


class Pages(DataSource):
    """Options: ``urls`` (a JSON list), ``agent``, ``timeout`` in seconds, ``perpartition``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, html string, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


def fetch(spark: SparkSession, urls: list[str], agent: str = AGENT, timeout: float = TIMEOUT) -> DataFrame:
    """``(url, html, error)`` of every address, repeated ones repeated."""
    spark.dataSource.register(Pages)
    return spark.read.format("pages").option("urls", json.dumps(urls)).option("agent", agent).option("timeout", timeout).load()
