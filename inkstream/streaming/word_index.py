"""A kept index for prefix search: words of articles in files by ranges of words, and batches that change or delete articles.

A batch writes the words of its articles, sorted, and then the ids that it is about, which makes it count.  A word of an
article holds as long as no later batch is about that article.  ``compact`` writes what holds after the last batch as one table,
which readers take together with the batches after it.  A batch that is run again writes its own places anew.

A prefix is pushed to the scan, where the files' least and greatest words leave out those that can't hold it, so a search
reads a range of the index and no texts.  Ranges are cut by (word, id), so a word that very many articles have is several files.
Articles without an id can't be found; what has no word is in the index only as an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scopes
from .evidence import written

_WORDS, _IDS = "token string, article_id long", "article_id long"


def _write(words: DataFrame, path: str, files: int | None) -> None:
    ordered = words.repartitionByRange(files, "token", "article_id") if files else words.repartitionByRange("token", "article_id")
    ordered.sortWithinPartitions("token", "article_id").write.mode("overwrite").parquet(path)


def add(articles: DataFrame, path: str, number: int, *columns: str, deleted: DataFrame | None = None, files: int | None = None) -> None:
    """Batch ``number`` (numbers only grow): new and changed ``articles`` (article_id and ``columns``), and ids of ``deleted`` ones.

    ``files`` fixes the number of files; else it follows the size of the batch.
    """
    ids = articles.select(F.col("article_id").cast("long"))
    ids = ids if deleted is None else ids.unionAll(deleted.select(F.col("article_id").cast("long")))
    words = scopes.word_index(articles.where("article_id IS NOT NULL"), *columns).select("token", F.col("article_id").cast("long"))
    _write(words, f"{path}/words-{number}", files)
    ids.distinct().write.mode("overwrite").parquet(f"{path}/batch-{number}")


def _holding(spark: SparkSession, path: str, wanted=None) -> DataFrame:
    """token, article_id, at (the batch) of words that hold; ``wanted``: a predicate for the scan."""
    whole = max(written(spark, path, "whole"), default=None)
    batches = [n for n in written(spark, path, "batch") if whole is None or n > whole]
    places = [(whole, f"{path}/whole-{whole}")] * (whole is not None) + [(n, f"{path}/words-{n}") for n in batches]
    words, about = spark.createDataFrame([], f"{_WORDS}, at long"), spark.createDataFrame([], f"{_IDS}, since long")
    for n, place in places:
        own = spark.read.schema(_WORDS).parquet(place)
        words = words.unionAll((own if wanted is None else own.where(wanted)).withColumn("at", F.lit(n).cast("long")))
    for n in batches:
        about = about.unionAll(spark.read.schema(_IDS).parquet(f"{path}/batch-{n}").withColumn("since", F.lit(n).cast("long")))
    last = about.groupBy("article_id").agg(F.max("since").alias("since"))
    held = words.join(last, "article_id", "left")
    return held.where("since IS NULL OR since = at").select("token", "article_id")


def search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """article_id of articles of which every word of ``query`` begins a word; none for a query without words."""
    found = None
    for word in scopes.query_words(query):
        own = _holding(spark, path, F.startswith("token", F.lit(word))).select("article_id").distinct()
        found = own if found is None else found.join(own, "article_id", "left_semi")
    return spark.createDataFrame([], _IDS) if found is None else found


def matching(articles: DataFrame, path: str, query: str) -> DataFrame:
    """``articles`` that the index finds; all of them for an empty query, as ``scopes.search`` has it."""
    return articles.join(search(articles.sparkSession, path, query), "article_id", "left_semi") if query else articles


def compact(spark: SparkSession, path: str, files: int | None = None) -> int | None:
    """The words that hold after the last batch as one table, which takes that batch's number; null if there is none."""
    number = max(written(spark, path, "batch"), default=None)
    if number is not None and number not in written(spark, path, "whole"):
        _write(_holding(spark, path), f"{path}/whole-{number}", files)
    return number
