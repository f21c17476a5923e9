"""Sources as plug-ins, and as a Spark data source that reads them page by page with pushed-down filters."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime
from typing import ClassVar

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition


@dataclass
class Stub:
    """An article as a source lists it."""

    url: str
    title: str = ""
    published_at: datetime | None = None
    date_confidence: str = "unknown"
    html: str | None = None
    extra: dict = field(default_factory=dict)


class Source:
    """``discover`` lists stubs; ``fetch_content`` gives an article's page; the rest are knobs."""

    plugin: ClassVar[str] = ""
    selectors: ClassVar[tuple[str, ...]] = ()
    furniture: ClassVar[str] = ""
    honours_limit: ClassVar[bool] = False

    def __init__(self, options: dict):
        self.options = options

    def discover(self, since: datetime | None = None, limit: int | None = None) -> Iterator[Stub]:
        raise NotImplementedError

    def fetch_content(self, stub: Stub) -> str:
        return stub.html or ""

    def clean(self, html: str, url: str, now: datetime) -> str:
        from ..functions.html import read_page

        return self.postprocess(read_page(html, url, now, self.selectors, self.furniture)["html"])

    def postprocess(self, html: str) -> str:
        return html

    def finish(self) -> dict:
        """Options to store after a run."""
        return {}


REGISTRY: dict[str, type[Source]] = {}


def register(cls: type[Source]) -> type[Source]:
    REGISTRY[cls.plugin] = cls
    return cls


def build(plugin: str, options: dict) -> Source:
    return REGISTRY[plugin](options)


@register
class JsonFolder(Source):
    """Pages of a posts API saved as files page-1.json, page-2.json ..., newest first: a stand-in for the network."""

    plugin, honours_limit = "json_folder", True
    #: Furniture of the two kinds of blog that such APIs belong to.
    furniture = ".sharedaddy, .jp-relatedposts, .kg-signup-card, .kg-cta-card"

    def page(self, number: int) -> list[dict]:
        try:
            with open(f"{self.options['path']}/page-{number}.json", encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return []

    def discover(self, since: datetime | None = None, limit: int | None = None) -> Iterator[Stub]:
        number = given = 0
        while rows := self.page(number := number + 1):
            fresh = 0
            for r in rows:
                at = datetime.fromisoformat(r["date"]) if r.get("date") else None
                if since and at and at < since:
                    continue
                if limit is not None and given >= limit:
                    return
                fresh, given = fresh + 1, given + 1
                yield Stub(r["link"], r.get("title", ""), at, "exact" if at else "unknown", r.get("content"))
            if not fresh:  # a page wholly older than the floor: those after it are older still
                return


class StubReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.since = options, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Lower bounds of published_at go to the source; Spark still checks them."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("published_at",):
                self.since = max(filter(None, [self.since, f.value]))
            yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.options["path"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        own = dict(self.options) | {"path": partition.value}
        limit = own.get("limit")
        for s in build(own.get("plugin", "json_folder"), own).discover(self.since, int(limit) if limit else None):
            yield s.url, s.title, s.published_at, s.date_confidence, s.html


class StubSource(DataSource):
    """spark.read.format("stubs").option("plugin", ...).option("path", "site1,site2").load(): a partition per site."""

    @classmethod
    def name(cls) -> str:
        return "stubs"

    def schema(self) -> str:
        return "url string, title string, published_at timestamp_ntz, date_confidence string, html string"

    def reader(self, schema) -> DataSourceReader:
        return StubReader(dict(self.options))


def install(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StubSource)


#: Fixed value: the largest limit.
MOST_LIMIT = 100_000


def parse_limit(text: str) -> int | None:
    """``all`` or 1 to 100,000."""
    if str(text).strip().lower() == "all":
        return None
    n = int(text)
    if not 1 <= n <= MOST_LIMIT:
        raise ValueError("a limit is 'all' or 1 to 100000")
    return n


def stored_limit(value: object) -> int | None:
    """A limit from stored options; none stored, or junk, is no limit."""
    whole = isinstance(value, int) and not isinstance(value, bool)
    return value if whole and 1 <= value <= MOST_LIMIT else None


def ordered_map(rows, fn: Callable, schema: str, key: str, partitions: int):
    """``mapInPandas`` spread over partitions by key; rows keep their pos, so the order can be had again."""
    return rows.repartition(partitions, key).mapInPandas(fn, schema)
