"""How a site is read, told from pages that were fetched: one row of advice per site.

``sites``: site, url as it was given.  ``pages``: url, status, body; a null status is a host that gave no answer, and a
page that isn't in the table was not fetched, which proves nothing.  A page counts as read if its status is 200.

Addresses to look at are laid out as rows, joined with the pages once, and folded per site, so the work is one shuffle
of narrow rows by address and one by site, whatever the number of sites.
"""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from .feeds import FEED_PATHS, SITEMAP_PATHS, _unescape, feed_hint, robots_sitemaps

# Paths that list all of a site, where posts APIs answer, and how much of a page is looked at.
LISTINGS = ("/archive", "/archives", "/posts", "/all", "/blog", "/writing", "/essays", "/articles", "/notes")
API_PATHS = ("/wp-json/wp/v2/posts?per_page=1", "/?rest_route=/wp/v2/posts&per_page=1")
API_ROOTS = ("/wp-json/wp/v2", "/?rest_route=/wp/v2")
CONTENT_KEY = r"""(?i)(?:key|apiKey)["']?\s*[:=]\s*["']([0-9a-f]{26})["']"""
FEED_HEAD, SITEMAP_HEAD = 4000, 2000

RESULT = ("site", "plugin", "name", "homepage", "config", "partial", "detected", "error")


def _base(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]*)", 1)


def _first(x: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def _under(base: Column, link: Column) -> Column:
    """A link of a home page made whole."""
    whole = F.when(link.rlike(r"^https?://"), link).when(F.startswith(link, F.lit("//")), F.concat(_first(base, r"^(https?:)"), link))
    return whole.otherwise(F.concat(base, F.lit("/"), F.regexp_replace(link, "^/+", "")))


def looks_like_feed(body: Column) -> Column:
    head = F.substring(body, 1, FEED_HEAD)
    return F.contains(head, F.lit("<rss")) | F.contains(head, F.lit("<feed"))


def feed_home(body: Column) -> Column:
    """The home page that a feed says it belongs to; null if the page is no feed."""
    head = F.substring(body, 1, FEED_HEAD)
    named = F.coalesce(_first(head, r"<link>\s*(https?://[^<\s]+)\s*</link>"), _first(head, r"""<link[^>]*rel=["']alternate["'][^>]*href=["'](https?://[^"']+)["']"""))
    return F.when(looks_like_feed(body), named)


def site_name(body: Column) -> Column:
    """The name that a page's markup gives its site, else the first part of its title."""
    meta = F.coalesce(*(_first(body, rf"""(?is)<meta\b(?=[^>]*\b(?:name|property|itemprop)=["']og:site_name["'])[^>]*\bcontent={q}([^{q}]*){q}""") for q in "\"'"))
    return F.coalesce(*(text.site_title(F.trim(_unescape(x))) for x in (meta, _first(body, r"(?is)<title\b[^>]*>(.*?)</title>"))))


def find_feed(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """sites: site, base, home (the home page's markup), stored (a hint; empty: known to have none).  site, feed."""
    known = F.when(F.col("stored") != "", _under(F.col("base"), F.col("stored"))).when(F.col("stored").isNull(), _under(F.col("base"), feed_hint(F.col("home"))))
    open_ = sites.where(F.col("stored").isNull() & feed_hint(F.col("home")).isNull())
    tried = open_.select("site", "base", F.posexplode(F.array(*map(F.lit, FEED_PATHS))).alias("k", "path")).select("site", "k", F.concat("base", "path").alias("url"))
    hits = tried.join(_read(pages).where(looks_like_feed(F.col("body"))).select("url"), "url").groupBy("site").agg(F.min_by("url", "k").alias("tried"))
    return sites.withColumn("known", known).join(hits, "site", "left").select("site", F.coalesce("known", "tried").alias("feed"))


def _read(pages: DataFrame) -> DataFrame:
    return pages.where("status = 200").select("url", F.coalesce("body", F.lit("")).alias("body"))


def _ask(rows: DataFrame) -> DataFrame:
    """site, what, k, url: every address to look at but sitemaps."""
    base, section, scoped = F.col("base"), F.col("section"), F.col("scoped")
    at = F.when(scoped, F.concat(base, section)).otherwise(base)
    one = lambda what, k, url, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(what).alias("what"), F.lit(k).alias("k"), url.alias("url")))
    wanted = [one("home", 0, base), one("robots", 0, F.concat(base, F.lit("/robots.txt"))), one("page", 0, F.col("url"), section != "")]
    wanted += [one("api", 0, F.concat(at, F.lit(API_PATHS[0]))), one("api", 1, F.concat(base, F.lit(API_PATHS[1])), ~scoped), one("own", 0, F.concat(at, F.lit("/wp-json/")), scoped)]
    return rows.select("site", F.explode(F.array_compact(F.array(*wanted))).alias("x")).select("site", "x.*")


def _answers(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """What the pages say, one row per site; of each page only what is needed."""
    body = F.when(F.col("status") == 200, F.coalesce("body", F.lit("")))
    is_ = lambda what: F.col("what") == what
    names = F.from_json(body, "struct<home:string,url:string>")
    facts = {
        "home_title": F.when(is_("home"), site_name(body)),
        "page_title": F.when(is_("page"), site_name(body)),
        "feed": F.when(is_("home"), feed_hint(body)),
        "key": F.when(is_("home") & F.contains(F.lower(body), F.lit("ghost")), _first(body, CONTENT_KEY)),
        "api": F.when(is_("api") & F.startswith(F.ltrim(body), F.lit("[")), F.col("k")),
        "subsite": F.when(is_("own"), F.transform(F.array(names["home"], names["url"]), lambda x: F.lower(F.rtrim(x, F.lit("/"))))),
        "listed": F.when(is_("robots"), robots_sitemaps(body)),
        "dead": F.when(is_("home"), F.col("status").isNull()),
    }
    found = _ask(rows).join(pages.select("url", "status", "body"), "url").select("site", *(v.alias(k) for k, v in facts.items()))
    return found.groupBy("site").agg(*(F.min(k).alias(k) for k in facts))


def _sitemaps(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows: site, base, listed.  site, sitemap (as it is named, null: none), absent (every place was refused for good)."""
    hints = F.concat(F.coalesce("listed", F.array().cast("array<string>")), F.array(*map(F.lit, SITEMAP_PATHS)))
    asked = rows.select("site", "base", F.posexplode(hints).alias("k", "hint")).select("site", "k", "hint", F.when(F.startswith("hint", F.lit("http")), F.col("hint")).otherwise(F.concat("base", "hint")).alias("url"))
    head = F.substring("body", 1, SITEMAP_HEAD)
    real = (F.col("status") == 200) & (F.contains(head, F.lit("<urlset")) | F.contains(head, F.lit("<sitemapindex")))
    seen = pages.select("url", F.coalesce(real, F.lit(False)).alias("real"), F.coalesce(F.col("status").isin(200, 404, 410), F.lit(False)).alias("sure"))
    found = asked.join(seen, "url", "left")
    return found.groupBy("site").agg(F.min_by("hint", F.when(F.col("real"), F.col("k"))).alias("sitemap"), F.bool_and(F.coalesce("sure", F.lit(False))).alias("absent"))


def detect(sites: DataFrame, pages: DataFrame, recipes: dict[str, dict] | None = None, today: date | None = None) -> DataFrame:
    """One row per site: plugin, name, homepage, config (JSON of strings), partial, detected; or an error.

    In this order: a recipe for the host (``recipes``: host to plugin, name, config, which is code and small); a posts API;
    a content key in the home page; a listing or a section, by the path that was given; a sitemap; else what feed and
    archive pages hold.  Where a feed was given, its home page is judged if that is elsewhere, and the feed is kept as a
    hint.  Null or blank addresses, and hosts that gave no answer, give an error; a repeated site is judged once.  A host
    whose every place for a sitemap was refused for good is remembered with the day (``today``).
    """
    pages = pages.dropDuplicates(["url"])
    given = F.trim(F.coalesce("url", F.lit("")))
    rows = sites.groupBy("site").agg(F.min("url").alias("url")).withColumn("url", F.when(given == "", None).when(given.rlike("^https?://"), given).otherwise(F.concat(F.lit("https://"), given)))
    mirrors = _read(pages).select("url", feed_home(F.col("body")).alias("belongs")).where("belongs IS NOT NULL")
    away = F.lower(urls.part(F.col("belongs"), "netloc")) != F.lower(urls.part(F.col("url"), "netloc"))
    rows = rows.join(mirrors, "url", "left").withColumn("mirror", F.when(away, F.col("url"))).withColumn("url", F.when(away, F.col("belongs")).otherwise(F.col("url"))).drop("belongs")

    section = F.rtrim(urls.part(F.col("url"), "path"), F.lit("/"))
    rows = rows.withColumns({"base": _base(F.col("url")), "section": F.coalesce(section, F.lit(""))})
    listing = F.lower("section").isin(*LISTINGS)
    rows = rows.withColumn("scoped", (F.col("section") != "") & ~listing)
    rows = rows.join(_answers(rows, pages), "site", "left")
    rows = rows.join(_sitemaps(rows.where("section = ''"), pages), "site", "left")

    host = F.lower(F.regexp_extract("base", r"^https?://(.*)$", 1))
    own = F.array_contains("subsite", F.lower(F.concat("base", "section")))
    api = F.when(~F.col("scoped") | F.coalesce(own, F.lit(False)), F.col("api"))
    api_root = F.concat("base", F.when(F.col("scoped"), F.col("section")).otherwise(""), F.element_at(F.array(*map(F.lit, API_ROOTS)), api + 1))
    gone = F.coalesce("absent", F.lit(False)) & F.col("sitemap").isNull()
    told = {k: urls.recipe_for(F.col("url"), {h: r if isinstance(r, str) else json.dumps(r) for h, r in ((h, x.get(k)) for h, x in (recipes or {}).items()) if r is not None}) for k in ("plugin", "name", "config")}

    title = F.when(F.col("scoped"), F.coalesce("page_title", "home_title")).otherwise(F.coalesce("home_title", "page_title"))
    name = F.coalesce(told["name"], title, F.replace(host, F.lit("www."), F.lit("")))
    recipe, has_api, ghost, path = told["plugin"].isNotNull(), api.isNotNull(), F.col("key").isNotNull() & ~F.col("scoped"), F.col("section") != ""
    failed = F.when(F.col("url").isNull(), "no address").when(~recipe & F.coalesce("dead", F.lit(False)), F.concat(host, F.lit(" gives no answer")))

    entries = {
        "api_root": F.when(~recipe & has_api, api_root),
        "content_key": F.when(~recipe & ~has_api & ghost, F.col("key")),
        "strategy": F.when(path, "archive"),
        "index": F.when(path, F.concat("section", F.lit("/"))),
        "path_prefix": F.when(F.col("scoped"), F.col("section")),
        "sitemap": F.when(~path, F.when(gone, "").otherwise(F.col("sitemap"))),
        "hints_checked": F.when(~path & gone, F.lit(today.isoformat() if today else None)),
    }
    plain = ~recipe & ~has_api & ~ghost
    by_hint = F.when(plain, _under(F.col("base"), F.col("feed")))
    options = {k: v if k in ("api_root", "content_key") else F.when(plain, v) for k, v in entries.items()} | {"feed": F.coalesce(by_hint, F.when(~recipe | ~F.contains(F.coalesce(told["config"], F.lit("")), F.lit('"feed"')), F.col("mirror")))}
    made = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, options)), F.array(*(v.cast("string") for v in options.values()))), lambda _, v: v.isNotNull())
    config = F.to_json(F.map_concat(F.coalesce(F.from_json(told["config"], "map<string,string>"), F.create_map().cast("map<string,string>")), made))

    route = (
        F.when(recipe, "built-in recipe").when(has_api, "posts API").when(ghost, "content API")
        .when(F.col("scoped"), F.concat(F.lit("section index at "), "section", F.lit("/"))).when(path, F.concat(F.lit("archive index at "), "section", F.lit("/")))
        .when(F.col("sitemap").isNotNull(), F.concat(F.lit("sitemap ("), "sitemap", F.lit(")"))).otherwise("archive pages and feed")
    )
    plugin = F.coalesce(told["plugin"], F.when(has_api, "wordpress").when(ghost, "ghost").otherwise("generic"))
    good = {"plugin": plugin, "name": name, "homepage": F.col("base"), "config": config, "partial": plain & ~path & F.col("sitemap").isNull(), "detected": route}
    return rows.select("site", *(F.when(failed.isNull(), v).alias(k) for k, v in good.items()), failed.alias("error"))
