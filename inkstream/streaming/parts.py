"""The archive kept in parts: a batch rewrites only those that its articles fall into.

Articles are dealt by a hash of (source_id, guid) to a fixed number of parts.  A batch reads the parts it touches, merges, and
writes them as its own version (``version=N/part=K``, by dynamic partition overwrite: other places stay as they are).  A table of
which version each part is in is written last and makes the batch count: until then readers see the state before.
A batch that is repeated after a failure begins from the same state and writes the same places.

Bytes written follow the batch: at most as many parts as it has articles.  The number of parts is fixed when the archive
is made; it should leave a part at about a file's size (some 128 MB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upsert

PARTS = 64
_NONE = -1  # the version of a part that no article has fallen into


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("source_id", "guid"), F.lit(parts)).cast("int")


def _versions(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Which version each part is in after batch ``number``: as many rows as parts."""
    return {r["part"]: r["version"] for r in spark.read.parquet(f"{path}/state-{number}").collect()}


def _commit(spark: SparkSession, path: str, number: int, versions: dict[int, int]) -> None:
    spark.createDataFrame(sorted(versions.items()), "part int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/state-{number}")


def _write(rows: DataFrame, path: str, number: int, parts: int, touched: int) -> None:
    """One file a part; the order inside is fixed, so that a repeated batch writes the same."""
    placed = rows.withColumn("version", F.lit(number)).withColumn("part", part_of(parts))
    placed = placed.repartition(max(1, touched), "part").sortWithinPartitions("part", *upsert.KEY)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "part").parquet(f"{path}/data")


def create(articles: DataFrame, path: str, parts: int = PARTS) -> None:
    """A new archive at ``path``, state 0."""
    spark = articles.sparkSession
    articles.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    _write(articles, path, 0, parts, parts)
    filled = {r["part"] for r in articles.select(part_of(parts).alias("part")).distinct().collect()}
    _commit(spark, path, 0, {k: 0 if k in filled else _NONE for k in range(parts)})


def read(spark: SparkSession, path: str, number: int, only: set[int] | None = None) -> DataFrame:
    """The articles after batch ``number``, or those of some parts."""
    schema = spark.read.parquet(f"{path}/schema").schema
    places = [f"{path}/data/version={v}/part={k}" for k, v in sorted(_versions(spark, path, number).items()) if v != _NONE and (only is None or k in only)]
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*places)


def last(spark: SparkSession, path: str) -> int:
    """The number of the last state that was written whole."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(where)]
    numbers = sorted((int(n.removeprefix("state-")) for n in names if n.startswith("state-")), reverse=True)
    return next(n for n in numbers if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/state-{n}/_SUCCESS")))


def merge(spark: SparkSession, path: str, batch: DataFrame, number: int) -> set[int]:
    """State ``number`` + 1: the articles of state ``number`` with ``batch`` (one row a key) upserted.  The parts that were rewritten."""
    versions = _versions(spark, path, number)
    parts = len(versions)
    touched = {r["part"] for r in batch.select(part_of(parts).alias("part")).distinct().collect()}  # at most all parts
    if touched:
        merged = upsert.upsert_articles(read(spark, path, number, touched), batch)
        _write(merged, path, number + 1, parts, len(touched))
    _commit(spark, path, number + 1, versions | dict.fromkeys(touched, number + 1))
    return touched


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete what only states older than the last ``keep`` use; the number of files' folders that went."""
    number = last(spark, path)
    jvm = spark.sparkContext._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    oldest = max(0, number - keep + 1)
    used = {(v, k) for n in range(oldest, number + 1) for k, v in _versions(spark, path, n).items()}
    gone = 0
    for version in fs.listStatus(at("data")):
        name = version.getPath().getName()
        if name.startswith("version=") and int(name[8:]) <= number:
            for part in fs.listStatus(version.getPath()):
                if (int(name[8:]), int(part.getPath().getName()[5:])) not in used:
                    fs.delete(part.getPath(), True)
                    gone += 1
    for n in range(oldest):
        fs.delete(at(f"state-{n}"), True)
    return gone
