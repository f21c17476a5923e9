"""Keyed reads: sources, articles, chapters and stored definitions, and what guards rows against deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nocase(name: Column) -> Column:
    """A key that folds ASCII letters only."""
    return F.translate(name, _UPPER, _LOWER)


def list_sources(sources: DataFrame, enabled_only: bool = False) -> DataFrame:
    rows = sources.where("enabled") if enabled_only else sources
    return rows.orderBy(nocase(F.col("source_name")), "source_id")


def get_source(sources: DataFrame, source_id: int) -> DataFrame:
    return sources.where(F.col("source_id") == source_id)


def get_article(articles: DataFrame, sources: DataFrame, article_id: int) -> DataFrame:
    """The article with its source's name."""
    return articles.where(F.col("article_id") == article_id).join(sources.select("source_id", "source_name"), "source_id")


def by_key(table: DataFrame, **key: object) -> DataFrame:
    """Rows of a key: a setting, a definition, an image, a note, a skip mark."""
    for name, value in key.items():
        table = table.where(F.col(name) == F.lit(value))
    return table


def user_rows(state: DataFrame, highlights: DataFrame, notes: DataFrame) -> DataFrame:
    """article_id of articles with any row of the reader's, each once."""
    return state.select("article_id").unionAll(highlights.select("article_id")).unionAll(notes.select("article_id")).distinct()


def with_user_data(articles: DataFrame, state: DataFrame, highlights: DataFrame, notes: DataFrame) -> DataFrame:
    """``articles`` and has_data: a note that isn't empty, a highlight, a mark or a scroll position.

    Give the chapters of a key or a source: the others' rows are left out before they are made distinct.
    """
    marks = [F.col(c).isNotNull() for c in ("read_at", "favourite_at", "skipped_at") if c in state.columns]
    marks += [F.col("scroll_pos") > 0] if "scroll_pos" in state.columns else []
    own = F.lit(False)
    for m in marks:
        own = own | m
    ids = user_rows(state.where(own), highlights, notes.where("body <> ''"))
    ids = ids.join(articles.select("article_id"), "article_id", "left_semi").withColumn("hit", F.lit(True))
    return articles.join(ids, "article_id", "left").withColumn("has_data", F.coalesce("hit", F.lit(False))).drop("hit")


def chapters_read(articles: DataFrame, state: DataFrame) -> DataFrame:
    """source_id, done: articles with a read mark."""
    read = state.where("read_at IS NOT NULL").select("article_id")
    return articles.select("source_id", "article_id").join(read, "article_id").groupBy("source_id").agg(F.count("*").alias("done"))


def cached(definitions: DataFrame) -> DataFrame:
    """word, payload of stored answers that are JSON objects; a corrupt one was never stored."""
    good = F.try_parse_json("payload").isNotNull() & F.startswith(F.ltrim("payload"), F.lit("{"))
    return definitions.where(good).select("word", "payload")


def definition_entry(word: Column, status: Column, payload: Column, source: str = "Wiktionary") -> Column:
    """What to store for an answer: a page that doesn't exist has no senses; other failures give null."""
    senses = F.coalesce(text.definitions(payload), F.array().cast("array<struct<part:string,text:string,example:string>>"))
    none = F.to_json(F.struct(word.alias("word"), F.array().cast("array<string>").alias("senses"), F.lit(source).alias("source")))
    found = F.to_json(F.struct(word.alias("word"), senses.alias("senses"), F.lit(source).alias("source")))
    return F.when(status == 404, none).when((status == 200) & F.try_parse_json(payload).isNotNull(), found)
