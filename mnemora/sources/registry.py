"""Connectors: named sources of documents, as Python data sources over paged fetches.

A connector fetches pages of plain rows. Registered as a Spark data source, each page
is a partition, so fetches run in parallel and a failed one is retried by itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "uri string, title string, text string, kind string, updated_at string"
CONNECTORS: dict[str, type] = {}
RETRY_STATUS = (429, 500, 502, 503, 504)


class TransientError(Exception):
    """A failure worth another attempt."""


def with_retry(call: Callable, attempts: int = 4, first: float = 1.0, sleep: Callable = time.sleep):
    """call's result; transient failures are tried again after 1, 2, 4 ... seconds."""
    for k in range(attempts):
        try:
            return call()
        except (TransientError, ConnectionError, TimeoutError):
            if k == attempts - 1:
                raise
            sleep(first * 2**k)
    return None


def as_bool(value, default: bool = False) -> bool:
    if value is None or value == "":
        return default
    return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")


def instance(names: list[str], wanted: str) -> str:
    """The one of several configured instances that is meant: by its name, else by a part of it; an error names the choice."""
    low = wanted.strip().lower()
    found = [n for n in names if n.lower() == low] or [n for n in names if low and low in n.lower()] or (names if not low else [])
    if len(found) != 1:
        raise KeyError(f"{wanted!r} fits {', '.join(found) or 'none'} of {', '.join(names)}")
    return found[0]


def register(name: str):
    def add(cls):
        CONNECTORS[name] = cls
        return cls

    return add


def create(name: str, **options):
    if name not in CONNECTORS:
        raise KeyError(f"no connector {name}; there are {', '.join(sorted(CONNECTORS))}")
    return CONNECTORS[name](**options)


@dataclass
class Connector:
    """pages() lists what to fetch; fetch(page, since) yields documents changed since then."""

    options: dict = field(default_factory=dict)

    def pages(self) -> list:
        return [0]

    def fetch(self, page, since: str | None) -> Iterator[tuple]:
        raise NotImplementedError


@dataclass
class Page(InputPartition):
    page: object

    def __init__(self, page):
        super().__init__(page)
        self.page = page


class _Reader(DataSourceReader):
    def __init__(self, connector: Connector, since: str | None):
        self.connector, self.since = connector, since

    def partitions(self):
        return [Page(p) for p in self.connector.pages()]

    def read(self, partition):
        rows = with_retry(lambda: list(self.connector.fetch(partition.page, self.since)))
        yield from (r for r in rows if not self.since or (r[4] or "") >= self.since)


def as_data_source(name: str, connector: Connector) -> type[DataSource]:
    """A data source `name` that reads the connector; option `since` is handed to it."""

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return _Reader(connector, self.options.get("since"))

    return Source


def read(spark: SparkSession, name: str, connector: Connector, since: str | None = None):
    spark.dataSource.register(as_data_source(name, connector))
    reader = spark.read.format(name)
    return (reader.option("since", since) if since else reader).load()
