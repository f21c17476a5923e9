"""Streams with keyed state: announcements once, and a run's allowance of undated posts.

State lives in the state store of the query's checkpoint, so it goes on over batches and restarts, and a lost
executor's part is loaded again from there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import NTZ

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """State on executors' disks and in the checkpoint, rather than on their heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def once(stream: DataFrame, at: str, delay: str = "2 days") -> DataFrame:
    """Each (source_id, guid) of a stream once: the state of one that was seen at ``at`` goes when the watermark, ``delay``
    behind the latest ``at``, has passed it by.  ``at`` is the time of arrival: a post that has no date has one as well.

    Null keys count as equal.  Which of the rows that share a key and a batch comes out isn't fixed.
    """
    timed = stream.withColumn(at, F.col(at).cast(T.TimestampType()))
    return timed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["source_id", "guid"]).withColumn(at, F.col(at).cast(NTZ))


class Allowance(StatefulProcessor):
    """For a source, how many undated posts this run has let in.  A later run's first row sets the count back.

    Rows of one batch are let in by their place.  No more are held than may still come in.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", T.StructType([T.StructField("run", T.LongType()), T.StructField("n", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = next(rows)
        held = self.used.get() if self.used.exists() else None
        used = held[1] if held and held[0] == first["run"] else 0
        free = max(0, first["allowed"] - used)
        let_in = heapq.nsmallest(free, _again(first, rows), key=lambda r: (r["pos"] is None, r["pos"] or 0, r["guid"] or ""))
        self.used.update((first["run"], used + len(let_in)))
        yield from let_in

    def close(self) -> None:
        pass


def _again(first: Row, rows: Iterator[Row]) -> Iterator[Row]:
    yield first
    yield from rows


def admitted(stream: DataFrame, known: DataFrame, floor: DataFrame, limits: DataFrame | None, run: int) -> DataFrame:
    """What a run takes of a stream of candidates (source_id, guid, published_at, pos, ...).

    Known ones (source_id, guid: as they were when the run began); dated ones that aren't older than their source's floor (source_id,
    floor; none: all); and of each source the first ``n`` undated unknown ones of the run (source_id, n), none of a source
    without a limit; without limits all of them.  ``run`` numbers the run: one that is taken up again after a failure keeps its number, and so its counts.

    Only undated unknown rows pass the state; the others go by it in their own tasks, so a large source is no large task there.
    """
    keep_state(stream.sparkSession)
    limited = limits is not None
    held = known.select(F.col("source_id").alias("k_source"), F.col("guid").alias("k_guid")).distinct()
    bounds = floor.select(F.col("source_id").alias("f_source"), "floor")
    rows = stream.join(held, F.col("source_id").eqNullSafe(F.col("k_source")) & F.col("guid").eqNullSafe(F.col("k_guid")), "left")
    rows = rows.join(bounds, F.col("source_id").eqNullSafe(F.col("f_source")), "left")
    is_known, dated = F.col("k_guid").isNotNull(), F.col("published_at").isNotNull()
    fresh = F.when(dated, F.col("floor").isNull() | (F.col("published_at") >= F.col("floor"))).otherwise(F.lit(not limited))
    plain = rows.where(is_known | fresh).select(stream.columns)
    if not limited:
        return plain
    allowed = limits.select(F.col("source_id").alias("l_source"), F.col("n").cast("long").alias("allowed"))
    undated = rows.where(~is_known & ~dated).join(allowed, F.col("source_id").eqNullSafe(F.col("l_source")), "left")
    undated = undated.select(*stream.columns, F.lit(run).cast("long").alias("run"), F.coalesce("allowed", F.lit(0)).cast("long").alias("allowed"))
    counted = undated.groupBy("source_id").transformWithState(Allowance(), undated.schema, "append", "none")
    return plain.unionByName(counted.select(stream.columns))
