"""Feeds, sitemaps, robots files and listing pages as rows, from a table of fetched pages (url, body as text)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, urls
from ..session import configure

# Where feeds and sitemaps are looked for, and sitemaps that hold no posts.
FEED_PATHS = ("/feed", "/feed/", "/rss", "/rss.xml", "/atom.xml", "/index.xml", "/feed.xml", "/blog/feed")
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml", "/sitemap-index.xml", "/sitemap-posts.xml")
NOT_POSTS = r"(?i)(image|video|news|category|categories|tag|authors?|term|user|product|attachment|misc|local)[-_]?sitemap|sitemap[-_]?(image|video|category|tag|authors?|misc|pt-)|[-_](category|tag|author|attachment|product)[-_]?\d*\.xml"
MOST_CHILDREN = 50


def _unescape(x: Column) -> Column:
    """Every character reference; only texts that hold one go through Arrow."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda v: None if v is None else html.unescape(v))

    return F.when(F.contains(x, F.lit("&")), run(x)).otherwise(x)


def tag(xml: Column, name: str) -> Column:
    """The first such element's content, CDATA unwrapped; null if there is none."""
    raw = F.regexp_extract(xml, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    inner = F.regexp_extract(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", 1)
    return F.nullif(F.coalesce(F.nullif(inner, F.lit("")), raw), F.lit(""))


def feed_link(xml: Column) -> Column:
    return _unescape(_raw_link(xml))


def _raw_link(xml: Column) -> Column:
    """alternate link, then the link's text, then any href, then a guid that is an address."""
    one = lambda p: F.nullif(F.trim(F.regexp_extract(xml, p, 1)), F.lit(""))
    guid = F.trim(tag(xml, "guid"))
    return F.coalesce(
        one(r"""(?s)<link\b(?=[^>]*\brel=["']alternate["'])[^>]*\bhref=["']([^"']+)["']"""),
        F.nullif(F.trim(tag(xml, "link")), F.lit("")),
        one(r"""<link\b[^>]*\bhref=["']([^"']+)["']"""),
        F.when(guid.rlike("^https?://"), guid),
    )


def feed_items(feeds: DataFrame, now: datetime) -> DataFrame:
    """feeds: site, page, xml.  One row per entry: site, page, pos, link, title, date struct, html, next."""
    entries = F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<(?:item|entry)[ >](.*?)</(?:item|entry)>"), 1)).alias("pos", "entry")
    after = F.nullif(F.regexp_extract("xml", r"""<(?:atom:)?link\b(?=[^>]*\brel=["']next["'])[^>]*\bhref=["']([^"']+)["']""", 1), F.lit(""))
    rows = feeds.select("site", "page", after.alias("next"), entries)
    e = F.col("entry")
    # Each part is bound to a column of its own, so that no pattern is written out more than once.
    rows = rows.select("site", "page", "pos", "next", *(tag(e, name).alias(f"own_{k}") for k, name in enumerate(("pubDate", "published", "updated", "dc:date", "title", "content:encoded", "content"))), _raw_link(e).alias("raw_link"))
    rows = rows.select("site", "page", "pos", "next", F.coalesce(*(F.col(f"own_{k}") for k in range(4)), F.lit("")).alias("stamp"), F.regexp_replace("own_4", r"<[^>]*>", "").alias("raw_title"), "own_5", "own_6", "raw_link")
    title = F.coalesce(F.nullif(F.trim(_unescape(F.col("raw_title"))), F.lit("")), F.lit("Untitled"))
    body = F.coalesce("own_5", _unescape(F.col("own_6")))
    return rows.select("site", "page", "pos", _unescape(F.col("raw_link")).alias("link"), title.alias("title"), dates.parse_rfc822(F.col("stamp"), now, "exact", "feed:date").alias("date"), body.alias("html"), "next")


def read_feed(feeds: DataFrame, now: datetime, floor: datetime | None = None, limit: int | None = None) -> DataFrame:
    """Entries of paged feeds, each once.

    A feed ends at the first page without a fresh entry, or wholly older than the floor; ``limit`` is per site.
    """
    items = feed_items(feeds, now).where("link IS NOT NULL").withColumn("guid", urls.canonical_url(F.col("link")))
    items = items.where(~urls.junk_feed_link(F.col("link")))
    first = Window.partitionBy("site", "guid").orderBy("page", "pos")
    items = items.withColumn("fresh", F.row_number().over(first) == 1)
    old = F.lit(False) if floor is None else F.coalesce(F.col("date.iso") < F.lit(floor).cast("timestamp_ntz"), F.lit(False))
    ends = items.groupBy("site", "page").agg(F.bool_or("fresh").alias("any_fresh"), F.bool_and(old).alias("all_old"))
    ends = ends.where(~F.col("any_fresh") | F.col("all_old")).groupBy("site").agg(F.min("page").alias("end"))
    out = items.join(ends, "site", "left").where(F.col("fresh") & (F.col("end").isNull() | (F.col("page") < F.col("end")) | (F.col("page") == F.col("end")) & ~old))
    if limit is not None:
        over = Window.partitionBy("site").orderBy("page", "pos")
        out = out.withColumn("k", F.row_number().over(over)).where(F.col("k") <= limit).drop("k")
    return out.drop("fresh", "end")


def feed_hint(page: Column) -> Column:
    """The feed that a home page names."""
    return F.nullif(F.regexp_extract(page, r"""(?i)<link\b(?=[^>]*\btype=["']application/(?:rss|atom)\+xml["'])[^>]*\bhref=["']([^"']+)["']""", 1), F.lit(""))


def robots_sitemaps(robots: Column) -> Column:
    """Sitemaps that a robots.txt names in its first 200 lines."""
    lines = F.slice(F.split(robots, r"\r\n|\r|\n"), 1, 200)
    named = F.transform(F.filter(lines, lambda x: F.lower(x).startswith("sitemap:")), lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", "")))
    return F.filter(named, lambda x: x.startswith("http"))


def read_sitemaps(pages: DataFrame, roots: DataFrame) -> DataFrame:
    """pages: url, body.  roots: site, url.  Addresses (site, pos, url, lastmod) two levels deep, in order.

    Of an index the first children count, and of these those that can hold posts are read; an address is one of the web, and no file.
    """
    level = roots.join(pages, "url").select("site", F.lit(0).cast("long").alias("order"), "body")
    out = None
    for depth in range(3):
        entry = F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<(?:url|sitemap)\b[^>]*>(.*?)</(?:url|sitemap)>"), 1)).alias("pos", "entry")
        rows = level.select("site", "order", F.col("body").contains("<sitemapindex").alias("index"), entry)
        rows = rows.select("site", (F.col("order") * 100_000 + F.col("pos")).alias("order"), "index", _unescape(F.trim(tag(F.col("entry"), "loc"))).alias("url"), tag(F.col("entry"), "lastmod").alias("lastmod"))
        page = F.col("url").startswith("http") & ~urls.is_asset(F.col("url"))
        found = rows.where((~F.col("index") | F.lit(depth == 2)) & page).drop("index")  # an index below two is read as a list
        out = found if out is None else out.unionByName(found)
        first = Window.partitionBy("site").orderBy("order")
        children = rows.where("index").withColumn("k", F.row_number().over(first)).where((F.col("k") <= MOST_CHILDREN) & ~F.col("url").rlike(NOT_POSTS))
        level = children.join(pages, "url").select("site", "order", "body")
    return out.withColumn("pos", F.row_number().over(Window.partitionBy("site").orderBy("order"))).select("site", "pos", "url", "lastmod")


def links(pages: DataFrame, now: datetime) -> DataFrame:
    """Links of listing pages that may be posts: page_url, pos, url, hint (the text around the link)."""
    from ..functions import html_tree as H

    configure(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import urljoin

        for batch in batches:
            rows = []
            for url, body in zip(batch.column("url").to_pylist(), batch.column("body").to_pylist(), strict=True):
                for pos, a in enumerate(n for n in H.parse(body).find("a") if n.attrs.get("href")):
                    href = re.sub(r"(?i)(?:%20|%09|%0[ad]|\s)+$", "", a.attrs["href"].split("#", 1)[0])
                    around = a.parent.text() if a.parent and a.parent.tag in ("li", "p", "td", "tr", "dd", "div") and len(a.parent.text()) <= 200 else a.text()
                    rows.append((url, pos, urljoin(url or "", href), a.text(), around.replace(a.text(), "", 1).strip()))
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64() if k == 1 else pa.string()) for k in range(5)], names=["page_url", "pos", "url", "text", "hint"])

    found = pages.select("url", "body").mapInArrow(run, "page_url string, pos long, url string, text string, hint string")
    fit = urls.same_site(F.col("url"), F.col("page_url")) & (urls.classify_url(F.col("url"), now) == "maybe") & F.col("url").rlike("^https?://")
    return found.where(fit)


def read_archive(pages: DataFrame, known: DataFrame, now: datetime) -> DataFrame:
    """pages: site, page, url, body.  Links of a paged listing in order, up to the first page that has nothing new."""
    found = links(pages, now).join(pages.select(F.col("url").alias("page_url"), "site", "page"), "page_url")
    found = found.withColumn("guid", urls.canonical_url(F.col("url")))
    found = found.withColumn("fresh", F.row_number().over(Window.partitionBy("site", "guid").orderBy("page", "pos")) == 1)
    found = found.join(known.select("guid", F.lit(True).alias("held")), "guid", "left")
    ends = found.groupBy("site", "page").agg(F.bool_or(F.col("fresh") & F.col("held").isNull()).alias("new")).where("NOT new").groupBy("site").agg(F.min("page").alias("end"))
    out = found.where("fresh").join(ends, "site", "left").where(F.col("end").isNull() | (F.col("page") < F.col("end")))
    return out.select("site", "page", "pos", "guid", "url", "text", "hint")


def _or_by_link(date: Column, link: Column, now: datetime) -> Column:
    return F.when(date["iso"].isNotNull(), date).otherwise(dates.parse_from_url(link, now))


def rest_posts(pages: DataFrame, now: datetime) -> DataFrame:
    """pages: site, page, body: JSON arrays of a posts API.  Published posts, as candidates."""
    kind = "array<struct<id:long,date_gmt:string,date:string,link:string,status:string,title:struct<rendered:string>,content:struct<rendered:string>>>"
    rows = pages.select("site", "page", F.posexplode(F.from_json("body", kind)).alias("pos", "p")).where(F.col("p.status").isNull() | (F.col("p.status") == "publish"))
    return rows.select("site", "page", "pos", F.col("p.link").alias("url"), urls.canonical_url(F.col("p.link")).alias("guid"), _unescape(F.regexp_replace("p.title.rendered", "<[^>]*>", "")).alias("title"), _or_by_link(dates.parse_iso(F.coalesce("p.date_gmt", "p.date"), now, "exact", "wp:date_gmt"), F.col("p.link"), now).alias("date"), F.col("p.content.rendered").alias("html"))


def content_api_posts(pages: DataFrame, now: datetime) -> DataFrame:
    """As ``rest_posts`` for an API that answers {"posts": [...]} with published_at."""
    kind = "struct<posts:array<struct<id:string,title:string,url:string,html:string,published_at:string,visibility:string>>>"
    rows = pages.select("site", "page", F.posexplode(F.from_json("body", kind)["posts"]).alias("pos", "p"))
    return rows.select("site", "page", "pos", F.col("p.url").alias("url"), urls.canonical_url(F.col("p.url")).alias("guid"), F.col("p.title").alias("title"), dates.parse_iso(F.col("p.published_at"), now, "exact", "ghost:published_at").alias("date"), F.col("p.html").alias("html"), F.when(F.coalesce(F.col("p.visibility"), F.lit("public")) != "public", "paywalled").alias("status_hint"))


def sitemap_stubs(addresses: DataFrame) -> DataFrame:
    """Candidates from addresses alone: titles from slugs, unknown dates."""
    u = F.col("url")
    return addresses.select("site", "pos", "url", urls.canonical_url(u).alias("guid"), urls.slug_title(u).alias("title"), F.lit(None).cast("timestamp_ntz").alias("published_at"))


def enumerated(sitemap: DataFrame, index: DataFrame, denied: str, resolved: DataFrame) -> DataFrame:
    """A site listed by its sitemap and index: both, without denied paths and what is settled."""
    both = sitemap.select("site", "url").union(index.select("site", "url")).withColumn("guid", urls.canonical_url(F.col("url")))
    return both.where(~urls.part(F.col("url"), "path").rlike(denied)).dropDuplicates(["guid"]).join(resolved.select("guid"), "guid", "left_anti")


def index_slugs(pages: DataFrame, pattern: str, denied: tuple[str, ...]) -> DataFrame:
    """A hand-written index: slugs by a pattern, in order, each once."""
    found = pages.select("url", F.posexplode(F.regexp_extract_all("body", F.lit(pattern), 1)).alias("pos", "slug")).where(~F.col("slug").isin(*denied))
    return found.groupBy("url", "slug").agg(F.min("pos").alias("pos"))
