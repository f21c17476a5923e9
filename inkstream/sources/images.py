"""A store of pictures named by their content, as a sink that commits.

Files stand at ``ab/abcd….png``.  A task writes each under a name of its own and moves it into place, so a file is whole or absent,
and tasks that are repeated or run twice leave one file a digest.  Which address has which picture is told by lists: a task
writes its own, and a commit names the lists that count.  Lists of failed tasks and jobs are never named; pictures that such a
job has left are whole and harmless, and are taken as they are by the next one that has them.

The driver gets one name a task, not rows.  Files are written with plain calls, so the folder must be one that driver and executors mount.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import text

_ROW = "url string, digest string, kind string, body binary"
LISTED = "url string, digest string, kind string, bytes long, relpath string"


def _plain(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _put(path: str, data: bytes) -> None:
    """A whole file or none."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    try:
        with open(own, "wb") as f:
            f.write(data)
        os.replace(own, path)
    finally:
        if os.path.exists(own):
            os.remove(own)


@dataclass
class Listed(WriterCommitMessage):
    name: str


class StoreWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Listed:
        name = f"{self.job}-{uuid.uuid4().hex}.json"
        # The list grows on disk, under a name that no commit gives, until the task is through.
        lists = f"{self.path}/_lists"
        os.makedirs(lists, exist_ok=True)
        with open(f"{lists}/{name}", "w", encoding="utf-8") as out:
            for r in iterator:
                place = f"{r.digest[:2]}/{r.digest}.{r.kind}"
                target = f"{self.path}/{place}"
                if not os.path.exists(target):
                    _put(target, bytes(r.body))
                out.write(json.dumps({"url": r.url, "digest": r.digest, "kind": r.kind, "bytes": len(r.body), "relpath": place}) + "\n")
        return Listed(name)

    def commit(self, messages: list[Listed | None]) -> None:
        _put(f"{self.path}/_commits/{self.job}", json.dumps([m.name for m in messages if m]).encode())

    def abort(self, messages: list[Listed | None]) -> None:
        for m in filter(None, messages):
            if os.path.exists(f"{self.path}/_lists/{m.name}"):
                os.remove(f"{self.path}/_lists/{m.name}")


class ImageStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_store"

    def writer(self, schema: StructType, overwrite: bool) -> StoreWriter:
        if overwrite:
            raise ValueError("a store of pictures is only added to")
        return StoreWriter(_plain(self.options["path"]))


def store(images: DataFrame, path: str) -> None:
    """images: url, mime, body.  What isn't a picture by its content or declared type, is too small or has no body is left out.

    Rows aren't shuffled: a picture under many addresses is one file, and each address is listed.
    """
    spark = images.sparkSession
    spark.dataSource.register(ImageStore)
    kept = images.select("url", F.sha2("body", 256).alias("digest"), text.sniff_image(F.col("body"), F.col("mime")).alias("kind"), "body").where("kind IS NOT NULL")
    kept.write.format("image_store").option("path", path).mode("append").save()


def stored(spark: SparkSession, path: str) -> DataFrame:
    """url, digest, kind, bytes, relpath of all jobs that were committed; a row for each time an address was stored."""
    path = _plain(path)
    commits = f"{path}/_commits"
    names = []
    for job in sorted(os.listdir(commits)) if os.path.isdir(commits) else []:
        if not job.startswith("."):
            with open(f"{commits}/{job}", encoding="utf-8") as f:
                names += json.load(f)
    places = [f"{path}/_lists/{n}" for n in names]
    return spark.read.schema(LISTED).json(places) if places else spark.createDataFrame([], LISTED)


def files(spark: SparkSession, path: str) -> DataFrame:
    """relpath and bytes of the pictures that are there; their contents aren't read.

    Each of the 256 folders is listed by a task, so names don't pass through the driver.
    """
    top = _plain(path)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                names, sizes = [], []
                if os.path.isdir(folder := f"{top}/{k:02x}"):
                    with os.scandir(folder) as found:
                        for f in found:
                            if not f.name.startswith(".") and "." in f.name:
                                names.append(f"{k:02x}/{f.name}")
                                sizes.append(f.stat().st_size)
                            if len(names) == 10_000:
                                yield pa.record_batch([pa.array(names), pa.array(sizes, pa.int64())], names=["relpath", "bytes"])
                                names, sizes = [], []
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["relpath", "bytes"])

    return spark.range(0, 256, 1, 64).mapInArrow(listed, "relpath string, bytes long")
