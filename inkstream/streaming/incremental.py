"""Incremental runs: candidates arrive as files, each micro-batch is merged into the parts of the archive that it touches.

The floor (newest stored date of a source less two days) and what is known are fixed when the run starts, so a watermark, which
moves during a run, would drop other rows; the stream is filtered by the frozen floor instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import merge
from . import parts, stateful


def floors(articles: DataFrame) -> DataFrame:
    """source_id, floor: fixed for a run."""
    return articles.groupBy("source_id").agg((F.max("published_at") - F.expr("INTERVAL '2' DAY")).alias("floor"))


def fresh_candidates(batch: DataFrame, articles: DataFrame, floor: DataFrame) -> DataFrame:
    """Known ones, and those that aren't older than their source's floor; undated ones pass."""
    known = articles.select("source_id", "guid", F.lit(True).alias("held"))
    rows = batch.join(known, ["source_id", "guid"], "left").join(floor, "source_id", "left")
    keep = F.col("held").isNotNull() | F.col("published_at").isNull() | F.col("floor").isNull() | (F.col("published_at") >= F.col("floor"))
    return rows.where(keep).select(batch.columns)


def _folder(spark: SparkSession, path: str):  # noqa: ANN202, objects of the JVM
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


_BEGUN = "run-from-"


def _begin(spark: SparkSession, archive: str) -> int:
    """The state that this run starts with, its floors written beside it; a run that failed is taken up with the one it had started with."""
    fs, top = _folder(spark, archive)
    begun = [n.removeprefix(_BEGUN) for n in (x.getPath().getName() for x in fs.listStatus(top)) if n.startswith(_BEGUN)]
    whole = [int(n) for n in begun if fs.exists(_folder(spark, f"{archive}/{_BEGUN}{n}/_SUCCESS")[1])]
    if whole:
        return min(whole)
    number = parts.last(spark, archive)
    floors(parts.read(spark, archive, number)).write.mode("overwrite").parquet(f"{archive}/{_BEGUN}{number}")
    return number


def run_once(spark: SparkSession, incoming: str, schema: T.StructType, archive: str, checkpoint: str, limits: DataFrame | None = None) -> int:
    """Merge all files that arrived in ``incoming`` into the archive of ``parts``; returns the number of batches.

    A batch is named by its number, so one that is repeated after a failure writes the same places again.  The folder run-from-N
    marks a run that isn't finished and holds its floors: when it is taken up after a failure, floor, known articles and the counts of
    undated posts are those it had, so the rows are those of a run without failure.  ``limits`` (source_id, n) bounds the undated
    unknown posts that a run takes of a source; without it all are taken.
    """
    begun = _begin(spark, archive)
    known, frozen = parts.read(spark, archive, begun).select("source_id", "guid"), spark.read.parquet(f"{archive}/{_BEGUN}{begun}")
    done: list[int] = []

    def apply(batch: DataFrame, number: int) -> None:
        # A guid that comes twice in a batch: the more confident date, then the first.
        rank = F.struct(merge.confidence_rank(F.col("date_confidence")).alias("k"), (-F.col("pos")).alias("p"))
        rest = [c for c in batch.columns if c not in ("source_id", "guid")]
        one = batch.groupBy("source_id", "guid").agg(F.max_by(F.struct(*rest), rank).alias("x")).select("source_id", "guid", "x.*").drop("pos")
        parts.merge(spark, archive, one, number)
        done.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    taken = stateful.admitted(stream, known, frozen, limits, begun)
    taken.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    fs, where = _folder(spark, f"{archive}/{_BEGUN}{begun}")
    fs.delete(where, True)
    return len(done)
