"""Figures per source and for the whole archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import READABLE

#: Articles a source needs before its skip percentage is shown.
RATED = 5


def skip_rates(articles: DataFrame, state: DataFrame) -> DataFrame:
    """skipped and rated per source; disabled sources count too."""
    rows = articles.where(F.col("content_status").isin(*READABLE)).join(state.select("article_id", "skipped_at"), "article_id", "left")
    return rows.groupBy("source_id").agg(F.count("skipped_at").alias("skipped"), F.count("*").alias("rated"))


def skip_percent(rates: DataFrame) -> DataFrame:
    shown = (F.col("skipped") > 0) & (F.col("rated") >= RATED)
    return rates.select("source_id", F.when(shown, F.bround(100.0 * F.col("skipped") / F.col("rated")).cast("long")).alias("percent"))


def library(articles: DataFrame, images: DataFrame) -> DataFrame:
    own = articles.agg(F.count("*").alias("articles"), F.count_if(F.col("content_status") == "ok").alias("ok"), F.min("published_at").alias("first"), F.max("published_at").alias("last"))
    kept = images.agg(F.count("*").alias("images"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return own.crossJoin(kept)  # one row each


def coverage(articles: DataFrame) -> DataFrame:
    """articles, dated, and the histogram of date confidence ('high: 3, exact: 1'), per source."""
    per = articles.groupBy("source_id", "date_confidence").agg(F.count("*").alias("n"), F.count("published_at").alias("d"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("date_confidence").alias("c"))))
    shown = F.array_join(F.transform(parts, lambda p: F.concat(p["c"], F.lit(": "), (-p["k"]).cast("string"))), ", ")
    return per.groupBy("source_id").agg(F.sum("n").alias("articles"), F.sum("d").alias("dated"), shown.alias("confidence"))


def cards(articles: DataFrame, state: DataFrame) -> DataFrame:
    rows = articles.join(state.select("article_id", "read_at"), "article_id", "left")
    ready = F.col("content_status").isin(*READABLE)
    year = F.year("published_at")
    return rows.groupBy("source_id").agg(
        F.count("*").alias("total"),
        F.count_if(ready).alias("ready"),
        (F.count("*") - F.count_if(ready)).alias("pending"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.count_if(ready & F.col("read_at").isNotNull()).alias("read"),
    )


def listing(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """Every source and its number of articles, zero included."""
    n = articles.groupBy("source_id").agg(F.count("*").alias("articles"))
    return sources.join(n, "source_id", "left").select("source_id", "source_name", "enabled", F.coalesce("articles", F.lit(0)).alias("articles"))


def newest_known(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source_id").agg(F.max("published_at").alias("newest"))


def orphan_images(images: DataFrame, references: DataFrame) -> DataFrame:
    return images.join(references, "image_id", "left_anti")


def image_references(articles: DataFrame) -> DataFrame:
    """Stored images that bodies name."""
    body = "content_html" if "content_html" in articles.columns else "body"
    found = F.regexp_extract_all(body, F.lit(r'src="(img/[^"]+)"'), 1)
    return articles.select(F.explode(found).alias("relpath")).distinct()
