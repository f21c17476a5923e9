"""A stream of a site's pages that stops asking once a page brings nothing new.

An offset is the number of pages of each site that a run has asked for.  A task that has read a page notes in a shared folder whether the next
one is worth asking for: it isn't after a page without rows, or all of whose rows are known or older than the floor.  The
next offset follows from these notes, so a query that is started again goes on where it was, and asks for no page twice but
those of a batch that wasn't finished.  A new run begins at the first pages again.

Options: ``plugin`` and ``path`` (sites, parted by commas) as for the batch source; ``notes`` (the shared folder), ``run`` (its number), and, where there
are any, ``known`` (a Parquet folder of site and url, best sorted by them) and ``floors`` (JSON: site to ISO time).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import configure
from ..sources import plugins

SCHEMA = "site string, page int, pos int, url string, title string, published_at timestamp_ntz, date_confidence string, html string"


#: Pages of a site that are written as one folder.
BLOCK = 1_000


def write_pages(listed: DataFrame, path: str) -> None:
    """listed: site, page (from 1), link, date (ISO), title, to ``path``/site=S/block=B, as ``parquet_pages`` reads them.

    A file has the pages of a block in order, so there are as many files as blocks, not as pages, and a page is read from its row groups.
    """
    placed = listed.withColumn("block", F.expr(f"(page - 1) div {BLOCK}"))
    placed = placed.repartition("site", "block").sortWithinPartitions("site", "block", "page")
    placed.write.option("parquet.block.row.count.limit", BLOCK).partitionBy("site", "block").parquet(path)


@plugins.register
class ParquetPages(plugins.Source):
    """Pages of a site as ``write_pages`` leaves them: columns page, link, date (ISO), title."""

    plugin = "parquet_pages"

    def page(self, number: int) -> list[dict]:
        import pyarrow.dataset as ds

        folder = f"{self.options['path'].removeprefix('file://')}/block={(number - 1) // BLOCK}"
        if not os.path.isdir(folder):
            return []
        return ds.dataset(folder, format="parquet").to_table(columns=["link", "date", "title"], filter=ds.field("page") == number).to_pylist()


class Page(InputPartition):
    def __init__(self, site: str, number: int):
        self.site, self.number = site, number


class PageReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.sites = options["path"].split(",")
        self.run = int(options.get("run", 0))

    def _note(self, site: str, number: int) -> str:
        return os.path.join(self.options["notes"], f"run-{self.run}", quote(site, safe=""), f"page-{number}")

    def initialOffset(self) -> dict:
        return {"run": self.run, "pages": {}}

    def _asked(self, site: str) -> int:
        """How many pages of a site may have been asked for after the next batch."""
        number = 1
        while os.path.exists(note := self._note(site, number)):
            with open(note, encoding="utf-8") as file:
                if file.read() != "more":
                    return number
            number += 1
        return number

    def latestOffset(self, *_) -> dict:
        return {"run": self.run, "pages": {s: self._asked(s) for s in self.sites}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        done = start["pages"] if start["run"] == end["run"] else {}
        return [Page(s, n) for s, last in sorted(end["pages"].items()) for n in range(done.get(s, 0) + 1, last + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        site, number = partition.site, partition.number
        rows = plugins.build(self.options.get("plugin", "json_folder"), dict(self.options) | {"path": site}).page(number)
        known, floor = self._known(site, [r["link"] for r in rows]), json.loads(self.options.get("floors", "{}")).get(site)
        floor, fresh = floor and datetime.fromisoformat(floor), False
        for pos, r in enumerate(rows):
            at = datetime.fromisoformat(r["date"]) if r.get("date") else None
            fresh = fresh or not (r["link"] in known or (floor and at and at < floor))
            yield site, number, pos, r["link"], r.get("title", ""), at, "exact" if at else "unknown", r.get("content")
        # Written under another name first: a note is there whole or not at all.
        note = self._note(site, number)
        os.makedirs(os.path.dirname(note), exist_ok=True)
        with open(f"{note}.{os.getpid()}", "w", encoding="utf-8") as file:
            file.write("more" if fresh else "end")
        os.replace(f"{note}.{os.getpid()}", note)

    def _known(self, site: str, links: list[str]) -> set[str]:
        """Those of a page's links that are known; where the table is sorted by site and url, its files' least and greatest values leave out the rest."""
        if not self.options.get("known") or not links:
            return set()
        import pyarrow.dataset as ds

        url = ds.field("url")
        own = (ds.field("site") == site) & (url >= min(links)) & (url <= max(links)) & url.isin(links)
        return set(ds.dataset(self.options["known"]).to_table(columns=["url"], filter=own).column("url").to_pylist())

    def commit(self, end: dict) -> None:
        pass


class PageStream(DataSource):
    """spark.readStream.format("site_pages"): a partition for each site's next page."""

    @classmethod
    def name(cls) -> str:
        return "site_pages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageReader(dict(self.options))


def read_run(spark: SparkSession, out: str, checkpoint: str, **options: str) -> DataFrame:
    """Ask for pages, one of each site a batch, until no site has more that is new; all rows that came so far in ``out``."""
    configure(spark)
    spark.dataSource.register(PageStream)
    stream = spark.readStream.format("site_pages").options(**options).load()
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(SCHEMA).parquet(out)
