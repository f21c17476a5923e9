"""The reading queue and what is counted over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import READABLE
from . import scopes, sequence


def marks(highlights: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per article: highlight count and first mark; note count and body.  One aggregate each, no row-wise lookup."""
    first = F.min_by(F.coalesce(F.nullif(F.col("note"), F.lit("")), F.col("quote")), F.struct(F.col("orphaned_at").isNotNull(), "start_offset", "highlight_id"))
    own = highlights.groupBy("article_id").agg(F.count("*").alias("highlight_count"), first.alias("first_mark"))
    written = notes.groupBy("article_id").agg(F.count("*").alias("note_count"), F.min("body").alias("note_body"))
    return own, written


def joined(articles: DataFrame, sources: DataFrame, state: DataFrame, highlights: DataFrame, notes: DataFrame) -> DataFrame:
    """Articles with their source, reading state and marks.  Sources are a dimension; the planner broadcasts them by size."""
    own, written = marks(highlights, notes)
    out = articles.join(sources, "source_id").join(state, "article_id", "left").join(own, "article_id", "left").join(written, "article_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("highlight_count", "note_count")})


def queue(archive: DataFrame, scope: str = "all", newest_first: bool = False, limit: int | None = None, offset: int = 0, search: str = "", **how) -> DataFrame:
    """Rows of a scope in reading order."""
    out = archive.where(scopes.scope_filter(scope, **how) & scopes.search(search, "title", "excerpt")).orderBy(*sequence.order_keys(newest_first))
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def counts(archive: DataFrame) -> DataFrame:
    """The eight figures of the side bar in one pass."""
    shown = F.col("content_status").isin(*READABLE) & F.col("enabled")
    open_ = shown & F.col("skipped_at").isNull()
    n = lambda c: F.count_if(open_ & c)
    unread = F.col("read_at").isNull()
    return archive.agg(
        F.count_if(shown & F.col("skipped_at").isNotNull()).alias("skipped"),
        F.count_if(open_).alias("all"),
        n(unread).alias("unread"),
        (F.count_if(open_) - n(unread)).alias("read"),
        n(F.col("favourite_at").isNotNull()).alias("favourites"),
        n((F.col("note_count") > 0) | (F.col("highlight_count") > 0)).alias("annotated"),
        n(F.col("highlight_count") > 0).alias("highlighted"),
        n(F.col("published_at").isNull()).alias("undated"),
    )


def first_unread(archive: DataFrame, newest_first: bool = False) -> DataFrame:
    return queue(archive, "unread", newest_first, limit=1)


def resume(archive: DataFrame, remembered: int | None, newest_first: bool = False) -> DataFrame:
    """The remembered article if it can be read, else the first unread one."""
    shown = archive.where(scopes.scope_filter("all"))
    both = shown.where(F.col("article_id") == F.lit(remembered)).withColumn("choice", F.lit(0))
    both = both.unionByName(first_unread(archive, newest_first).withColumn("choice", F.lit(1)))
    return both.orderBy("choice").limit(1).drop("choice")


def year_headers(rows: DataFrame, newest_first: bool = False) -> DataFrame:
    """The label of a row and whether a header stands before it, along the reading order."""
    label = F.coalesce(F.date_format("published_at", "yyyy"), F.lit("Undated"))
    rows = sequence.labelled_before(rows.withColumn("label", label), "label", newest_first)
    return rows.withColumn("header", F.col("before").isNull() | (F.col("before") != F.col("label"))).drop("before")


def highlight_order() -> list[Column]:
    return [F.col("orphaned_at").isNotNull().asc(), F.col("start_offset").asc_nulls_first(), F.col("highlight_id").asc()]


def annotated_ids(notes: DataFrame, highlights: DataFrame) -> DataFrame:
    return notes.select("article_id").union(highlights.select("article_id")).distinct()


def annotation_counts(articles: DataFrame, notes: DataFrame, highlights: DataFrame) -> DataFrame:
    own, written = marks(highlights, notes)
    out = articles.select("article_id").join(own, "article_id", "left").join(written, "article_id", "left")
    return out.select("article_id", F.coalesce("highlight_count", F.lit(0)).cast("long").alias("highlights"), F.coalesce("note_count", F.lit(0)).cast("long").alias("notes"))
