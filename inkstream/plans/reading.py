"""More registered queries: sources read back from what was written in their formats, changes to the archive, text helpers.

Feeds, sitemaps, listings and posts are made from ``documents`` in their own format and read by the engine; the SQL says
what stood in them straight from the table, so it shares no rule with the reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import bytes_text, dates, text, urls
from ..operators import merge, schedule, upsert
from ..session import configure
from ..sources import feeds
from .archive import NOW_PAGES, query

NTZ = "timestamp_ntz"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    at = F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(CAST(doc_id % 1400 AS INT), CAST(doc_id % 24 AS INT), CAST(doc_id % 60 AS INT))")
    return spark.read.parquet(f"{d}/documents.parquet").select(i, (i % 20).cast("string").alias("site"), F.expr("CAST(doc_id div 500 + 1 AS INT)").alias("page"), at.alias("at"), "text")


_AT = "TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(doc_id % 1400 AS INTEGER)) + to_hours(doc_id % 24) + to_minutes(doc_id % 60)"
_SITE = "CAST(doc_id % 20 AS VARCHAR)"


def _joined(rows: DataFrame, keys: list[str], item: Column, head: str, tail: str, name: str) -> DataFrame:
    """One text per key from its items in the order of ``doc_id``."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))), lambda x: x["item"])
    return rows.groupBy(*keys).agg(F.concat(F.lit(head), F.array_join(own, "\n"), F.lit(tail)).alias(name))


def _id(before: str, after: str = "") -> Column:
    return F.concat(F.lit(before), F.col("doc_id").cast("string"), F.lit(after))


def _entry() -> Column:
    stamp = F.concat(F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    body = F.concat(F.lit("<p>"), F.replace(F.col("text"), F.lit("]]>"), F.lit("")), F.lit("</p>"))
    parts = [_id("<item><title>&Eacute;t&eacute; &amp; fils &#35;", "</title>"), _id("<link>https://s.example/p/", "?a=1&amp;b=2</link>"), F.concat(F.lit("<pubDate>"), stamp, F.lit("</pubDate>")), F.concat(F.lit("<content:encoded><![CDATA["), body, F.lit("]]></content:encoded></item>"))]
    return F.concat(*parts)


@query(f"SELECT {_SITE} AS site, 'https://s.example/p/' || doc_id || '?a=1&b=2' AS link, 'Été & fils #' || doc_id AS title, {_AT} - INTERVAL 2 HOUR AS published_at, 'day' AS precision, '<p>' || replace(text, ']]>', '') || '</p>' AS html FROM documents")
def feed_entries(spark, d):
    made = _joined(_docs(spark, d), ["site", "page"], _entry(), "<rss><channel>", "</channel></rss>", "xml")
    got = feeds.feed_items(made, NOW_PAGES)
    return got.select("site", "link", "title", F.col("date.iso").alias("published_at"), F.col("date.precision").alias("precision"), "html")


@query(f"SELECT {_SITE} AS site, 'Two ' || doc_id AS title, 'https://a.example/' || doc_id AS link, {_AT} AS published_at FROM documents")
def atom_entries(spark, d):
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.concat(_id("<entry ><title type='text'><![CDATA[Two ", "]]></title>"), _id("<link rel='self' href='x'/><link rel='alternate' href='https://a.example/", "'/>"), F.lit("<published>"), stamp, F.lit("</published></entry>"))
    got = feeds.feed_items(_joined(_docs(spark, d), ["site", "page"], item, "<feed>", "</feed>", "xml"), NOW_PAGES)
    return got.select("site", "title", "link", F.col("date.iso").alias("published_at"))


@query(f"SELECT site, 'https://s.example/p/' || doc_id || '?a=1&b=2' AS guid FROM (SELECT {_SITE} AS site, doc_id, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS k FROM documents) WHERE k <= 8")
def feed_pages(spark, d):
    """Pages of five entries, the newest first eight of each site."""
    rows = _docs(spark, d).withColumn("page", F.floor(F.col("doc_id") / 100).cast("int"))
    return feeds.read_feed(_joined(rows, ["site", "page"], _entry(), "<rss>", "</rss>", "xml"), NOW_PAGES, limit=8).select("site", "guid")


@query(f"SELECT site, row_number() OVER (PARTITION BY site ORDER BY child, doc_id) AS pos, 'https://s.example/' || doc_id AS url, strftime(stamp, '%Y-%m-%d') AS lastmod FROM (SELECT {_SITE} AS site, doc_id, CAST(doc_id // 20 % 4 AS INTEGER) AS child, {_AT} AS stamp FROM documents) WHERE child < 3")
def sitemap_urls(spark, d):
    """Of an index the first 50 children, of these the ones that can hold posts; files and other schemes are no posts."""
    docs = _docs(spark, d).withColumn("child", F.expr("CAST(doc_id div 20 % 4 AS INT)"))
    entry = F.concat(_id("<url><loc> https://s.example/", "</loc>"), F.lit("<lastmod>"), F.date_format("at", "yyyy-MM-dd"), F.lit("</lastmod></url>"), _id("<url><loc>https://s.example/", ".pdf</loc></url><url><loc>ftp://s.example/x</loc></url><url><loc>/relative</loc></url>"))
    children = _joined(docs, ["site", "child"], entry, "<urlset>", "</urlset>", "body").select(F.concat("site", F.lit("/"), F.col("child").cast("string")).alias("url"), "body")
    loc = lambda x: F.concat(F.lit("<sitemap><loc>"), x, F.lit("</loc></sitemap>"))
    sites = docs.select("site").distinct()
    roots = sites.select(F.concat(F.lit("root"), "site").alias("url"), F.concat(F.lit("<sitemapindex>"), *(loc(F.concat("site", F.lit(f"/{k}"))) for k in range(3)), *[loc(F.lit("x/image-sitemap.xml"))] * 47, loc(F.concat("site", F.lit("/3"))), F.lit("</sitemapindex>")).alias("body"))
    got = feeds.read_sitemaps(children.unionByName(roots), sites.select("site", F.concat(F.lit("root"), "site").alias("url")))
    return got.select("site", F.col("pos").cast("long").alias("pos"), "url", "lastmod")


@query("SELECT doc_id, ['https://s.example/' || doc_id || '.xml', 'https://t.example/x'] AS found FROM documents")
def robots_files(spark, d):
    body = F.concat(F.lit("User-agent: *\nDisallow:\r\nSITEMAP:  "), _id("https://s.example/", ".xml"), F.lit("\nSitemap: /relative.xml\nSitemap: https://t.example/x"))
    return _docs(spark, d).select("doc_id", feeds.robots_sitemaps(body).alias("found"))


@query(f"SELECT {_SITE} AS site, 'https://s.example/post-' || doc_id AS url, 'Post ' || doc_id AS text, CAST(day(stamp) AS VARCHAR) || ' May ' || year(stamp) AS hint FROM (SELECT doc_id, {_AT} AS stamp FROM documents)")
def listing_links(spark, d):
    configure(spark)
    item = F.concat(_id("<li><a href='/post-", "#top'>"), _id("Post ", "</a> "), F.dayofmonth("at").cast("string"), F.lit(" May "), F.year("at").cast("string"), F.lit("</li><li><a href='/tag/x'>t</a></li><li><a href='https://other.org/y'>o</a></li>"))
    pages = _joined(_docs(spark, d), ["site"], item, "<ul>", "</ul>", "body").select("site", F.lit(1).alias("page"), F.concat(F.lit("https://s.example/list"), "site").alias("url"), "body")
    known = spark.createDataFrame([], "guid string")
    return feeds.read_archive(pages, known, NOW_PAGES).select("site", "url", "text", "hint")


@query(f"SELECT {_SITE} AS site, 'https://s.example/' || doc_id AS guid, 'A & B ' || doc_id AS title, {_AT} AS published_at, text AS html FROM documents WHERE doc_id % 3 <> 0")
def rest_api_posts(spark, d):
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")
    post = F.to_json(F.struct(F.col("doc_id").alias("id"), stamp.alias("date_gmt"), _id("https://www.s.example/", "/").alias("link"), F.when(F.col("doc_id") % 3 == 0, "draft").otherwise("publish").alias("status"), F.struct(_id("A &amp; <b>B</b> ").alias("rendered")).alias("title"), F.struct(F.col("text").alias("rendered")).alias("content")))
    rows = _docs(spark, d)
    made = rows.groupBy("site", "page").agg(F.concat(F.lit("["), F.array_join(F.collect_list(post), ","), F.lit("]")).alias("body"))
    return feeds.rest_posts(made, NOW_PAGES).select("site", "guid", "title", F.col("date.iso").alias("published_at"), "html")


@query(f"SELECT {_SITE} AS site, 'https://g.example/' || doc_id AS guid, {_AT} AS published_at, CASE WHEN doc_id % 4 = 0 THEN 'paywalled' END AS status_hint FROM documents")
def content_api_posts(spark, d):
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    post = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), _id("https://g.example/").alias("url"), stamp.alias("published_at"), F.when(F.col("doc_id") % 4 == 0, "members").otherwise("public").alias("visibility")))
    made = _docs(spark, d).groupBy("site", "page").agg(F.concat(F.lit('{"posts": ['), F.array_join(F.collect_list(post), ","), F.lit("]}")).alias("body"))
    return feeds.content_api_posts(made, NOW_PAGES).select("site", "guid", F.col("date.iso").alias("published_at"), "status_hint")


@query(f"SELECT doc_id, 'https://s.example/a-post-' || doc_id AS guid, 'A post ' || doc_id AS title FROM documents")
def sitemap_stubs(spark, d):
    rows = _docs(spark, d).select("site", F.col("doc_id").alias("pos"), _id("https://s.example/a-post-", "/").alias("url"))
    return feeds.sitemap_stubs(rows).select(F.col("pos").alias("doc_id"), "guid", "title")


@query("SELECT event_id, date_trunc('second', ts) + INTERVAL 5 HOUR AS at FROM events")
def rfc822_dates(spark, d):
    stamp = F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" -0500"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", stamp.alias("x")).select("event_id", dates.parse_rfc822(F.col("x"), NOW_PAGES)["iso"].alias("at"))


@query("SELECT event_id, date_trunc(CASE event_id % 4 WHEN 2 THEN 'month' WHEN 3 THEN 'year' ELSE 'day' END, ts) AS at, CASE event_id % 4 WHEN 2 THEN 'month' WHEN 3 THEN 'year' ELSE 'day' END AS precision, CASE event_id % 4 WHEN 3 THEN 'inferred' ELSE 'medium' END AS confidence FROM events")
def freeform_dates(spark, d):
    k = F.col("event_id") % 4
    stamp = F.when(k == 0, F.date_format("ts", "'Posted on' MMMM d, yyyy")).when(k == 1, F.date_format("ts", "d MMM yyyy")).when(k == 2, F.date_format("ts", "MMMM yyyy")).otherwise(F.date_format("ts", "'in' yyyy"))
    got = spark.read.parquet(f"{d}/events.parquet").select("event_id", stamp.alias("x")).select("event_id", dates.parse_freeform(F.col("x"), NOW_PAGES).alias("y"))
    return got.select("event_id", F.col("y.iso").alias("at"), F.col("y.precision").alias("precision"), F.col("y.confidence").alias("confidence"))


@query(f"SELECT doc_id, date_trunc('day', make_timestamp((epoch_us(a) + epoch_us(b)) // 2)) AS both, a AS single, CASE WHEN doc_id % 2 = 0 THEN 'month' ELSE 'year' END AS precision FROM (SELECT doc_id, {_AT} AS a, TIMESTAMP '2022-06-01 23:00:00' AS b FROM documents)")
def interpolated_dates(spark, d):
    """Between two dates in either order; with one alone a copy of it."""
    a, b, none = F.col("at"), F.lit("2022-06-01 23:00:00").cast(NTZ), F.lit(None).cast(NTZ)
    both, one = dates.interpolate(a, b), dates.interpolate(none, a)
    return _docs(spark, d).select("doc_id", both["iso"].alias("both"), one["iso"].alias("single"), F.when(F.col("doc_id") % 2 == 0, both["precision"]).otherwise(one["precision"]).alias("precision"))


# Changes to the archive.


@query("SELECT article_id, CASE WHEN article_id % 3 = 0 THEN 'New body' ELSE body END AS body, CASE WHEN article_id % 3 = 0 THEN 'partial' ELSE content_status END AS content_status FROM fx_articles")
def update_content(spark, d):
    a = view(spark, d, "fx_articles").select("article_id", "body", "content_status")
    new = a.where("article_id % 3 = 0").select("article_id", F.lit("New body").alias("body"), F.lit("partial").alias("content_status"))
    return upsert.update_content(a, new)


@query("SELECT article_id, CASE WHEN article_id % 3 = 0 THEN 'gone' ELSE 'error' END AS content_status, body[1:120] AS content_error FROM fx_articles")
def content_errors(spark, d):
    code = F.element_at(F.array(F.lit(404), F.lit(500), F.lit(403)), (F.col("article_id") % 3 + 1).cast("int"))
    return view(spark, d, "fx_articles").select("article_id", upsert.content_error(code, F.col("body")).alias("x")).select("article_id", "x.*")


@query("SELECT article_id, CASE WHEN article_id % 2 = 0 THEN 'Changed' ELSE body END AS body FROM fx_notes WHERE article_id % 3 <> 0 AND trim(coalesce(body, '')) <> '' OR article_id % 3 <> 0 AND article_id % 2 = 0")
def changed_notes(spark, d):
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast(NTZ).alias("updated_at")
    notes = view(spark, d, "fx_notes").select("article_id", "body", at(1))
    i = F.col("article_id")
    changes = notes.where((i % 2 == 0) | (i % 3 == 0)).select("article_id", F.when(i % 3 == 0, "  ").otherwise("Changed").alias("body"), at(2))
    return upsert.set_notes(notes, changes).select("article_id", "body")


@query("SELECT highlight_id, CASE WHEN highlight_id % 3 = 0 THEN 7 ELSE start_offset END AS start_offset, CASE WHEN highlight_id % 3 = 0 THEN NULL WHEN highlight_id % 3 = 1 THEN coalesce(orphaned_at, TIMESTAMP '2024-05-05 00:00:00') ELSE orphaned_at END AS orphaned_at FROM fx_highlights")
def reanchored_highlights(spark, d):
    marks = view(spark, d, "fx_highlights").select("highlight_id", "start_offset", "orphaned_at")
    i = F.col("highlight_id")
    found = marks.where(i % 3 != 2).select("highlight_id", F.when(i % 3 == 0, 7).alias("offset"))
    return upsert.reanchor(marks, found, F.lit("2024-05-05 00:00:00").cast(NTZ))


@query("SELECT source_id, source_name FROM fx_sources UNION ALL SELECT source_id + 1000, 'new' || source_id FROM fx_sources")
def added_sources(spark, d):
    own = view(spark, d, "fx_sources").select("source_id", "source_name")
    new = own.select(F.col("source_id") + 1000, F.concat(F.lit("new"), F.col("source_id").cast("string"))).toDF("source_id", "source_name")
    return upsert.insert_or_ignore(own, own.withColumn("source_id", F.lit(-1).cast("long")).unionByName(new), "source_name")


@query("SELECT source_id, CASE WHEN source_id % 2 = 0 THEN 'b' || source_id ELSE 'a' END AS x, '1' AS kept, CAST(source_id AS VARCHAR) AS added FROM fx_sources")
def merged_config(spark, d):
    i = F.col("source_id").cast("string")
    new = F.to_json(F.create_map(F.lit("added"), i, F.when(F.col("source_id") % 2 == 0, "x").otherwise("unused"), F.concat(F.lit("b"), i)))
    got = view(spark, d, "fx_sources").select("source_id", F.from_json(upsert.merge_config(F.lit('{"x": "a", "kept": "1"}'), new), "map<string,string>").alias("m"))
    return got.select("source_id", *(F.col("m")[k].alias(k) for k in ("x", "kept", "added")))


@query("SELECT source_id, CASE WHEN source_id % 3 = 0 THEN 'N' || source_id ELSE source_name END AS source_name, CASE WHEN source_id % 3 = 0 THEN FALSE ELSE enabled END AS enabled FROM fx_sources")
def updated_sources(spark, d):
    own = view(spark, d, "fx_sources")
    i = F.col("source_id")
    changes = own.where(i % 3 != 1).select("source_id", F.when(i % 3 == 0, F.concat(F.lit(" N"), i.cast("string"))).otherwise("  ").alias("source_name"), F.when(i % 3 == 0, False).alias("enabled"))
    return upsert.update_sources(own, changes)


@query("SELECT article_id FROM fx_articles WHERE source_id <> 4")
def cascaded_articles(spark, d):
    return upsert.cascade(4, view(spark, d, "fx_sources"), view(spark, d, "fx_articles"))["articles"].select("article_id")


@query("SELECT n.article_id FROM fx_notes n WHERE n.article_id NOT IN (SELECT article_id FROM fx_articles WHERE source_id = 4)")
def cascaded_notes(spark, d):
    return upsert.cascade(4, view(spark, d, "fx_sources"), view(spark, d, "fx_articles"), notes=view(spark, d, "fx_notes"))["notes"].select("article_id")


@query("SELECT doc_id % 500 AS article_id FROM documents GROUP BY 1 HAVING max(doc_id % 97) >= 90")
def automatic_read(spark, d):
    rows = _docs(spark, d).select((F.col("doc_id") % 500).alias("article_id"), (F.col("doc_id") % 97 / 97.0).alias("fraction"))
    return upsert.auto_read(rows)


@query("SELECT article_id, content_status IN ('ok', 'partial') AND article_id % 2 = 0 AND article_id % 100 < 50 AS teaser, content_status IN ('pending', 'error') OR content_status = 'gone' AND article_id % 3 = 0 OR article_id % 7 = 0 AS wanted FROM fx_articles")
def body_selection(spark, d):
    i, status = F.col("article_id"), F.col("content_status")
    teaser = upsert.teaser(F.when(i % 2 == 0, "feed").otherwise("page"), status, i % 100)
    return view(spark, d, "fx_articles").select("article_id", teaser.alias("teaser"), upsert.body_wanted(status, i % 3 == 0, i % 7 == 0).alias("wanted"))


@query("SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 = 0 OR greatest(doc_id % 5, doc_id % 4) <= 1 AND doc_id % 7 <> 0 AS reject, CASE WHEN doc_id % 4 > doc_id % 5 THEN 'page' ELSE 'stub' END AS date_from, CASE WHEN doc_id % 80 < 50 AND doc_id % 200 >= 50 AND doc_id % 200 >= 2 * (doc_id % 80) THEN 'page' ELSE 'stub' END AS body_from FROM documents")
def probe_verdict(spark, d):
    i = F.col("doc_id")
    return _docs(spark, d).select("doc_id", merge.verdict(i % 5, i % 4, i % 2 == 0, i % 3 == 0, i % 7 == 0, i % 80, i % 200).alias("x")).select("doc_id", "x.*")


@query("SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 5 <> 0 AND doc_id % 60 >= 50 AS complete FROM documents")
def complete_candidates(spark, d):
    i = F.col("doc_id")
    rows = _docs(spark, d).select("doc_id", F.when(i % 2 == 0, "x").alias("html"), F.when(i % 3 == 0, F.col("at")).alias("published_at"), F.lit("t").alias("title"), (i % 5 == 0).alias("foreign"))
    return rows.select("doc_id", merge.complete(rows, i % 60).alias("complete"))


@query("SELECT TRUE AS ascending")
def sitemap_direction(spark, d):
    rows = _docs(spark, d).select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 2 == 1, F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(CAST(doc_id AS INT))")).alias("published_at"))
    return merge.sitemap_ascending(rows)


# Text and addresses.


@query("SELECT doc_id, 'https://e.com/a?x=1&page=' || doc_id AS paged, 'https://e.com/?rest_route=/wp/v2/posts&per_page=' || doc_id AS posts, 'https://e.com/' || doc_id AS unwrapped, 'A long post ' || doc_id AS slug, doc_id % 2 = 0 AS junk FROM documents")
def address_helpers(spark, d):
    i = F.col("doc_id").cast("string")
    return _docs(spark, d).select(
        "doc_id",
        urls.with_query_param(F.lit("https://e.com/a?page=7&x=1"), "page", F.col("doc_id")).alias("paged"),
        urls.posts_url(F.lit("https://e.com/?rest_route=/wp/v2/posts"), F.concat(F.lit("per_page="), i)).alias("posts"),
        urls.unwrap_archived(_id("https://web.archive.org/web/20200101000000id_/https://e.com/")).alias("unwrapped"),
        urls.slug_title(_id("https://e.com/x/a-long_post-", ".html")).alias("slug"),
        urls.junk_feed_link(F.when(F.col("doc_id") % 4 == 0, "https://e.com/").when(F.col("doc_id") % 2 == 0, _id("https://e.com/a", ".png")).otherwise(_id("https://e.com/a"))).alias("junk"),
    )


@query("SELECT doc_id, 'https://e.com/' || doc_id || '/é' AS x, CASE doc_id % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'two' END AS recipe FROM documents")
def addresses_of_pages(spark, d):
    configure(spark)
    joined = F.udf(urls.absolutise)
    where = F.element_at(F.array(F.lit("https://blog.one.org/x"), F.lit("https://www.two.org"), F.lit("https://zone.org/")), (F.col("doc_id") % 3 + 1).cast("int"))
    return _docs(spark, d).select("doc_id", joined(F.lit("https://e.com/a/b"), _id("../", "/é")).alias("x"), urls.recipe_for(where, {"one.org": "one", "two.org": "two"}).alias("recipe"))


@query("SELECT doc_id, 'A long title ' || doc_id AS title, 'Site ' || doc_id % 100 AS site, CASE WHEN doc_id % 2 = 0 THEN '“Mark ' || doc_id || '”' ELSE 'Note ' || doc_id END AS line, TRUE AS n, 'By · ' || doc_id AS byline, '&lt;' || doc_id || ' &amp; &quot;x&quot;&gt;' AS escaped, '{\"a\":\"<\\/script>' || doc_id || '\"}' AS embedded FROM documents")
def labels_of_rows(spark, d):
    i = F.col("doc_id").cast("string")
    return _docs(spark, d).select(
        "doc_id",
        text.clean_title(_id("A  long title ", " | My Site")).alias("title"),
        text.site_title(F.concat(F.lit("Site "), (F.col("doc_id") % 100).cast("string"), F.lit(" | a motto"))).alias("site"),
        text.note_line(F.when(F.col("doc_id") % 2 == 1, _id("Note  ")), _id("Mark ")).alias("line"),
        (F.replace(text.thousands(F.col("doc_id") * 1001), F.lit(" "), F.lit("")) == (F.col("doc_id") * 1001).cast("string")).alias("n"),
        text.byline(F.lit("By"), F.lit(None).cast("string"), F.lit(""), i).alias("byline"),
        text.escape_html(_id("<", ' & "x">')).alias("escaped"),
        text.safe_json(F.struct(_id("</script>").alias("a"))).alias("embedded"),
    )


@query("SELECT doc_id, ['/a' || doc_id || '.png', 'b.jpg'] AS images, 'word' || chr(CAST(97 + doc_id % 26 AS INTEGER)) AS headword, ['One ' || doc_id, 'March 2020 and more', 'Last'] AS lines, 'March 2020 and more' AS dateline, 'it’s ' || doc_id AS repaired, CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'empty' END AS assessed FROM documents")
def body_helpers(spark, d):
    page = _id("<p>One&nbsp;", "</p><p>March 2020<b> and more</b></p>Last")
    lines = text.body_lines(F.replace(F.replace(page, F.lit("<b>"), F.lit("")), F.lit("</b>"), F.lit("")))
    return _docs(spark, d).select(
        "doc_id",
        text.image_urls(_id("<IMG class=x src='/a", ".png'><img src=\"b.jpg\"><img src='b.jpg'><img src='data:x'>")).alias("images"),
        text.headword(F.concat(F.lit("“Word"), F.char((F.col("doc_id") % 26 + 97).cast("long")), F.lit("’s,”"))).alias("headword"),
        lines.alias("lines"),
        text.dateline(lines).alias("dateline"),
        text.repair_c1(_id("it\x92s ")).alias("repaired"),
        text.assess(F.when(F.col("doc_id") % 4 == 0, F.repeat(F.lit("word "), 20)).when(F.col("doc_id") % 2 == 0, "<img src=x>").otherwise("few words")).alias("assessed"),
    )


@query("SELECT doc_id, least(30.0, CASE WHEN doc_id % 2 = 0 THEN doc_id % 50 ELSE 3 END) AS delay, 'é’ ' || doc_id AS decoded FROM documents")
def fetched_bytes(spark, d):
    configure(spark)
    delay = F.udf(lambda x: bytes_text.crawl_delay(x, "reader/1.0"), "double")
    own = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("User-agent: reader\nCrawl-delay: "), (F.col("doc_id") % 50).cast("string"))).otherwise("")
    return _docs(spark, d).select("doc_id", delay(F.concat(F.lit("User-agent: *\nCrawl-delay: 3\n\n"), own)).alias("delay"), bytes_text.decoded(F.encode(_id("é’ "), "UTF-8"), F.lit("text/html; charset=iso-8859-1")).alias("decoded"))


@query(f"SELECT doc_id, 'A real heading ' || doc_id AS title, CASE WHEN doc_id % 10 = 0 THEN 0.0 ELSE doc_id % 10 / 10.0 END AS resume, doc_id % 10 > 0 AS hint FROM documents")
def headings_and_places(spark, d):
    place = F.col("doc_id") % 10 / 10.0
    title = text.heading_title(F.when(F.col("doc_id") % 2 == 0, "Untitled").otherwise("A post"), _id(" A real heading "), F.lit("https://e.com/a-post"))
    return _docs(spark, d).select("doc_id", title.alias("title"), text.resume_scroll(F.when(place > 0, place)).alias("resume"), text.shows_resume_hint(place).alias("hint"))
