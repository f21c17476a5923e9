"""Evidence about an article from several routes, merged to one row, and the newest of them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import confidence_rank

#: The order in which routes are taken in.
ROUTES = ("archive", "sitemap", "feed")


def route_rank(route: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ROUTES)), route) - 1


def states(rows: DataFrame) -> DataFrame:
    """Each row as what is known by it alone; columns as for ``merge``."""
    for name, kind in (("url", "string"), ("title", "string"), ("html", "string"), ("foreign", "boolean"), ("date_precision", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rank, pos = route_rank(F.col("route")), F.col("pos")
    seq = F.struct(rank.alias("r"), pos.alias("p"))
    best = F.struct(confidence_rank(F.col("date_confidence")).alias("k"), (-rank).alias("r"), (-pos).alias("p"))
    full = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    first = lambda c: F.when(full(c).isNotNull(), F.struct(seq.alias("seq"), full(c).alias("x"))).alias(c)
    dated = F.when(F.col("published_at").isNotNull(), F.struct(best.alias("best"), "published_at", "date_confidence", "date_precision"))
    return rows.select("guid", F.array_compact(F.array("route")).alias("evidence"), F.struct(seq.alias("seq"), F.col("url").alias("x")).alias("url"), dated.alias("date"), first("title"), first("html"), F.coalesce("foreign", F.lit(False)).alias("foreign"))


def combined(known: DataFrame) -> DataFrame:
    """One state a guid.  Least, greatest and union only: any order, any grouping and repeated states give the same."""
    return known.groupBy("guid").agg(
        # At most as many different lists as there are sets of routes.
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"),
        F.min("url").alias("url"),
        F.max("date").alias("date"),
        F.min("title").alias("title"),
        F.min("html").alias("html"),
        F.bool_or("foreign").alias("foreign"),
    )


def merged(state: DataFrame) -> DataFrame:
    """What states say in the end."""
    dates = [F.col(f"date.{c}").alias(c) for c in ("published_at", "date_confidence", "date_precision")]
    return state.select("guid", F.col("url.x").alias("url"), F.col("url.seq").alias("seq"), "evidence", *dates, F.col("title.x").alias("title"), F.col("html.x").alias("html"), "foreign")


def merge(rows: DataFrame) -> DataFrame:
    """``rows``: guid, url, route, pos, title, html, published_at, date_confidence, foreign (missing ones are null).

    Routes in order; of each guid the first url and order, all routes, the first title and body that aren't empty, the
    most confident known date (the first of equals), and whether any link led off the site.  Where rows share route and
    place, the least url, title and body and the latest date count.
    """
    return merged(combined(states(rows)))


def probe_order() -> list[Column]:
    """More routes first, then site order."""
    return [F.size("evidence").desc(), F.col("seq").asc()]


def newest(pool: DataFrame, n: int, sitemap_ascending: bool = False) -> DataFrame:
    """The newest ``n``: dated by date, then undated in site order (from the end, if the sitemap ascends)."""
    site = F.col("seq").desc() if sitemap_ascending else F.col("seq").asc()
    return pool.orderBy(F.col("published_at").desc_nulls_last(), site).limit(n)


def sitemap_ascending(rows: DataFrame) -> DataFrame:
    """One row: whether the last dated entry (pos) is newer than the first; needs two."""
    dated = rows.where("published_at IS NOT NULL")
    ends = dated.agg(F.count("*").alias("n"), F.min_by("published_at", "pos").alias("a"), F.max_by("published_at", "pos").alias("b"))
    return ends.select(F.coalesce((F.col("n") >= 2) & (F.col("b") > F.col("a")), F.lit(False)).alias("ascending"))


def report(rows: DataFrame) -> DataFrame:
    """Rows and guids of each route."""
    return rows.groupBy("route").agg(F.count("*").alias("n"), F.count_distinct("guid").alias("guids"))


def report_summary(rows: DataFrame) -> DataFrame:
    """One line about a run: 'archive 3, feed 2; 4 articles'."""
    per = rows.groupBy("route").agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(route_rank(F.col("route")).alias("k"), "route", "n"))), lambda x: F.concat_ws(" ", x["route"], x["n"].cast("string"))), ", ")
    return per.agg(listed.alias("routes")).crossJoin(rows.agg(F.count_distinct("guid").alias("unique"))).select(F.concat(F.col("routes"), F.lit("; "), F.col("unique").cast("string"), F.lit(" articles")).alias("summary"))


def known_state(known: DataFrame, cooling: Column) -> DataFrame:
    """guid, state: what is held of an article (ok, gone, cooling, missing)."""
    status = F.col("content_status")
    state = F.when(status.isin("ok", "partial", "paywalled"), "ok").when(status == "gone", "gone").when((status == "error") & cooling, "cooling").otherwise("missing")
    return known.withColumn("state", state)


def settled(dated: Column, state: Column) -> Column:
    return dated & (state == "ok")


def no_direct(dated: Column, state: Column) -> Column:
    """No request is needed."""
    return dated & state.isin("ok", "gone", "cooling")


def rejected(candidates: DataFrame, rejects: DataFrame, epoch: int) -> DataFrame:
    """Candidates that weren't rejected under the present rules."""
    return candidates.join(rejects.where(F.col("epoch") == epoch).select("guid").distinct(), "guid", "left_anti")


def resolved(rows: DataFrame, rejects: DataFrame, epoch: int) -> DataFrame:
    """``rows`` (guid, published_at, state) and resolved: held with a date, or rejected under the present rules."""
    bad = rejects.where(F.col("epoch") == epoch).select("guid").distinct().withColumn("bad", F.lit(True))
    done = no_direct(F.col("published_at").isNotNull(), F.col("state")) | F.col("bad").isNotNull()
    return rows.join(bad, "guid", "left").withColumn("resolved", F.coalesce(done, F.lit(False))).drop("bad")


def admits_members(path_prefix: Column, index: Column) -> Column:
    """Whether all links of an index belong to the section: only if the index is the section."""
    return F.coalesce((path_prefix != "") & (F.rtrim(index, F.lit("/")) == path_prefix), F.lit(False))


def dates_agree(date: Column) -> Column:
    """Whether all known dates of a group are one; false if none is known."""
    return F.coalesce(F.min(date) == F.max(date), F.lit(False))


def within_limits(rows: DataFrame, limits: DataFrame, most: int = 100_000) -> DataFrame:
    """The newest rows of each source up to its limit (limits: source_id, n; null: all), and all known ones.

    Dated by date, then undated by source_order.  ``most`` is the largest limit there can be.
    """
    rows = rows.join(limits.select("source_id", "n"), "source_id", "left")
    over = Window.partitionBy("source_id").orderBy(F.col("published_at").desc_nulls_last(), "source_order", "guid")
    free = rows.where("n IS NULL OR known").drop("n")
    # The fixed bound lets each task drop all but its first rows before the shuffle.
    held = rows.where("n IS NOT NULL").withColumn("rk", F.row_number().over(over)).where((F.col("rk") <= most) & (F.col("rk") <= F.col("n")) & ~F.col("known"))
    return free.unionByName(held.drop("n", "rk"))


def floor_of(newest_known: datetime | None) -> datetime | None:
    """Older unknown posts are dropped in an incremental run; fixed when the run starts."""
    return None if newest_known is None else newest_known - timedelta(days=2)


def fresh(rows: DataFrame, floor: datetime | None, limit: int | None = None) -> DataFrame:
    """Known rows; dated ones that aren't below the floor; the first ``limit`` undated unknown ones in order of arrival.

    rows: guid, arrival, published_at, known.
    """
    undated = F.col("published_at").isNull() & ~F.col("known")
    keep = F.col("known") | (~undated & (F.lit(True) if floor is None else F.col("published_at") >= F.lit(floor).cast("timestamp_ntz")))
    if limit is None:
        return rows.where(keep | undated)
    first = rows.where(undated).orderBy("arrival").limit(limit).select("arrival", F.lit(True).alias("within"))
    return rows.join(first, "arrival", "left").where(keep | (undated & F.col("within"))).drop("within")


def newest_or_known(rows: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` of each source, and all known ones.  Dated by date, then undated by source_order."""
    over = Window.partitionBy("source_id").orderBy(F.col("published_at").desc_nulls_last(), "source_order", "article_id")
    return rows.withColumn("rk", F.row_number().over(over)).where((F.col("rk") <= n) | F.col("known")).drop("rk")


def newest_stored(articles: DataFrame, n: int) -> DataFrame:
    over = Window.partitionBy("source_id").orderBy(F.col("published_at").desc_nulls_last(), "article_id")
    return articles.withColumn("rk", F.row_number().over(over)).where(F.col("rk") <= n)


def complete(pool: DataFrame, words: Column) -> Column:
    """Whether a candidate needs no probe."""
    return F.col("html").isNotNull() & F.col("published_at").isNotNull() & F.col("title").isNotNull() & (words >= 50) & ~F.col("foreign")


def verdict(stub_rank: Column, page_rank: Column, off_site: Column, foreign: Column, article: Column, stub_words: Column, page_words: Column) -> Column:
    """What a probed page means: reject, which date and which body to take."""
    weak = (F.greatest(stub_rank, page_rank) <= confidence_rank(F.lit("inferred"))) & ~article
    return F.struct(
        ((foreign & off_site) | weak).alias("reject"),
        F.when(page_rank > stub_rank, "page").otherwise("stub").alias("date_from"),
        F.when((stub_words < 50) & (page_words >= 50) & (page_words >= 2 * stub_words), "page").otherwise("stub").alias("body_from"),
    )
