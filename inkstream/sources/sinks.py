"""Writers: JSON export and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text


def export_rows(queue: DataFrame, with_content: bool = False) -> DataFrame:
    """One JSON object per article, in the order of the queue."""
    columns = [c for c in ("article_id", "source_name", "title", "url", "published_at", "date_precision", "excerpt", "read_at", "favourite_at") if c in queue.columns]
    columns += ["body"] if with_content and "body" in queue.columns else []
    return queue.select(F.to_json(F.struct(*columns)).alias("json"))


def write_export(queue: DataFrame, path: str, with_content: bool = False) -> None:
    export_rows(queue, with_content).write.mode("overwrite").text(path)


def queue_lines(queue: DataFrame) -> DataFrame:
    """date, source and title as the command line shows them."""
    return queue.select(F.rpad(dates.format_short(F.col("published_at"), F.col("date_precision")), 10, " ").alias("date"), F.rpad(F.substring("source_name", 1, 18), 18, " ").alias("source"), F.substring("title", 1, 64).alias("title"))


def source_lines(listing: DataFrame) -> DataFrame:
    mark = F.when(F.col("enabled"), " ").otherwise("-")
    return listing.select(F.concat(mark, F.lit(" "), F.rpad("source_name", 24, " "), F.lpad(text.thousands(F.col("articles")), 9, " ")).alias("line"))
