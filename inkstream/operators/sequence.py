"""The reading order: dated articles by date, undated ones last whichever way it runs.

Dated: (published_at, source_order, id), all turned by the direction.  Undated: (source_id, source_order, id), always
ascending.  The same keys give the order, the rank and the comparison, so they agree.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder

KEYS = ("published_at", "source_id", "source_order", "article_id")


def order_keys(newest_first: bool = False, forward: bool = True) -> list[Column]:
    """Columns to order by; a backward walk turns every key."""
    undated = F.col("published_at").isNull()

    def way(c: Column, descending: bool) -> Column:
        return c.desc_nulls_last() if descending else c.asc_nulls_first()

    turned, back = newest_first == forward, not forward
    return [
        way(undated.cast("int"), back),
        way(F.col("published_at"), turned),
        *(way(F.when(undated, F.col(c)), back) for c in ("source_id", "source_order", "article_id")),
        way(F.col("source_order"), turned),
        way(F.col("article_id"), turned),
    ]


def after(anchor: Mapping, newest_first: bool = False, forward: bool = True) -> Column:
    """Whether a row comes strictly after ``anchor`` (strictly before it, if not forward).

    The anchor is given by value, so it need not be in the set any more.
    """
    undated = F.col("published_at").isNull()
    place, number = anchor["source_order"], anchor["article_id"]

    def past(columns: list[tuple[Column, object]], descending: bool) -> Column:
        out, same = F.lit(False), F.lit(True)
        for c, x in columns:
            x = F.lit(x)
            out = out | (same & ((c < x) if descending else (c > x)))
            same = same & (c == x)
        return out

    if anchor["published_at"] is None:
        own = past([(F.col("source_id"), anchor["source_id"]), (F.col("source_order"), place), (F.col("article_id"), number)], not forward)
        return undated & own if forward else ~undated | own
    own = past([(F.col("published_at"), anchor["published_at"]), (F.col("source_order"), place), (F.col("article_id"), number)], newest_first == forward)
    own = F.coalesce(~undated & own, F.lit(False))
    return own | undated if forward else own


def _place(newest_first: bool) -> Column:
    """The order as one ascending struct of numbers."""
    undated, sign = F.col("published_at").isNull(), -1 if newest_first else 1
    at = F.unix_micros(F.col("published_at").cast("timestamp_ltz"))
    last = [F.when(undated, F.col(c)).otherwise(F.lit(0)).cast("long") for c in ("source_id", "source_order", "article_id")]
    parts = [undated.cast("long"), F.coalesce(at * sign, F.lit(0)), *last, (F.col("source_order") * sign).cast("long"), (F.col("article_id") * sign).cast("long")]
    return F.struct(*(F.coalesce(c, F.lit(-(2**62))).alias(f"k{k}") for k, c in enumerate(parts)))


#: Rows of a range of the order: what one task sorts.
RANGE_ROWS = 1_000_000


def _written(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _in_ranges(df: DataFrame, newest_first: bool, parts: int | None) -> tuple[DataFrame, int]:
    """``df``, written, with order_place, and order_at: the range of the order that a row is in and its number inside; the number of ranges.

    What ``df`` is made of is worked out once.  Ranges are cut by Spark from a sample of the narrow written table, as many as its rows ask
    for, so a range doesn't grow with the table, and a hot date or source is cut as well.
    """
    rows = _written(df.withColumn("order_place", _place(newest_first)))
    ranges = parts or max(1, -(-rows.count() // RANGE_ROWS))
    placed = rows.repartitionByRange(ranges, "order_place").sortWithinPartitions("order_place").withColumn("order_at", F.monotonically_increasing_id())
    return (_written(placed) if ranges > 1 else placed), ranges


def _range() -> Column:
    return F.shiftright("order_at", 33).cast("int")  # as Spark numbers rows: the task, then the row


def _from(values: Mapping, absent: Column) -> Column:
    """A value for each range, as a literal map; as many as there are ranges."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[_range()] if values else absent


def ranked(df: DataFrame, newest_first: bool = False, name: str = "rank", parts: int | None = None) -> DataFrame:
    """A row number along the order: ranges are numbered by themselves, and begin after the rows of those before.

    The columns of ``df`` are written on the way, so it should have those only that are wanted.
    """
    rows, ranges = _in_ranges(df, newest_first, parts)
    before, start = 0, {}
    if ranges > 1:
        for r in sorted(rows.groupBy(_range().alias("range")).count().collect()):  # a row for each range
            start[r["range"]] = before
            before += r["count"]
    base = _from(start, F.lit(0)).cast("long")
    return rows.withColumn(name, F.col("order_at").bitwiseAND(2**33 - 1) + 1 + base).drop("order_place", "order_at")


def labelled_before(df: DataFrame, label: str, newest_first: bool = False, name: str = "before", parts: int | None = None) -> DataFrame:
    """The label of the row before along the order (null for the first); columns as for ``ranked``."""
    rows, ranges = _in_ranges(df, newest_first, parts)
    edge = {}
    if ranges > 1:
        last = {r["range"]: r["last"] for r in rows.groupBy(_range().alias("range")).agg(F.max_by(label, "order_place").alias("last")).collect()}
        edge = {b: last[a] for a, b in zip(sorted(last), sorted(last)[1:], strict=False)}
    inside = Window.partitionBy(_range()).orderBy("order_place")
    return rows.withColumn(name, F.coalesce(F.lag(label).over(inside), _from(edge, F.lit(None).cast("string")))).drop("order_place", "order_at")


def neighbour(df: DataFrame, anchor: Mapping, newest_first: bool = False, forward: bool = True) -> DataFrame:
    """The next (or previous) row: a filter and a top one, without sorting the set."""
    return df.where(after(anchor, newest_first, forward)).orderBy(*order_keys(newest_first, forward)).limit(1)


def position(df: DataFrame, anchor: Mapping, newest_first: bool = False) -> DataFrame:
    """pos (from 1) and total, in one counting pass."""
    return df.agg((F.count_if(after(anchor, newest_first, forward=False)) + 1).alias("pos"), F.count("*").alias("total"))
