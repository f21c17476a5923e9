"""Registered queries over what is rendered from the tables first: whole pages, sites, books and bodies.

As in ``reading``, the SQL says what went into a page, straight from the table, and shares no rule with what reads it.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import anchors, bytes_text, html, text, urls
from ..operators import schedule, upsert
from ..session import configure, shared_folder
from ..sources import content, detection, epub, feeds, images, sinks
from ..streaming import incremental, pages, parts, stateful
from .archive import NOW, NOW_PAGES, query
from .reading import _AT, _docs, _id

_FILL = "Plain words fill this paragraph, and more of them follow. "


# Pages.


@query(
    f"""SELECT doc_id, 'Page ' || doc_id AS title, CASE WHEN doc_id % 5 < 4 THEN date_trunc('day', {_AT}) END AS published_at,
CASE doc_id % 5 WHEN 0 THEN 'jsonld:datePublished' WHEN 1 THEN 'meta:published' WHEN 2 THEN 'time:datetime' WHEN 3 THEN 'url:permalink' ELSE '' END AS date_source,
CASE WHEN doc_id % 5 < 2 THEN 'exact' WHEN doc_id % 5 < 4 THEN 'high' ELSE 'unknown' END AS date_confidence,
doc_id % 5 = 0 OR doc_id % 3 = 0 AS is_article, 'Own line ' || doc_id || ' ' || trim(repeat('{_FILL}', 9)) AS text FROM documents"""
)
def page_fields(spark, d):
    """Titles, dates by the sign they stand in, article-ness and text of pages with menus around an article."""
    configure(spark)
    k, day = F.col("doc_id") % 5, F.date_format("at", "yyyy-MM-dd")
    ld = F.when(k == 0, F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": "BlogPosting", "datePublished": "'), day, F.lit('"}]}</script>'))).otherwise("")
    meta = F.when(k == 1, F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('">'))).otherwise("")
    kind = F.when(F.col("doc_id") % 3 == 0, '<meta content="article" property="og:type">').otherwise("")
    stamp = F.when(k == 2, F.concat(F.lit('<time class="entry-date" datetime="'), day, F.lit('"></time>'))).otherwise("")
    url = F.concat(F.lit("https://s.example/"), F.when(k == 3, F.date_format("at", "yyyy/MM/dd/")).otherwise(""), F.lit("post"))
    head = F.concat(_id('<html><head><title>x</title><meta name="twitter:title" content="Page ', '">'), ld, meta, kind)
    body = F.concat(F.lit("</head><body><nav><a href='/'>Home</a></nav>"), stamp, _id("<article><p>Own line ", "</p><p>"), F.repeat(F.lit(_FILL), 9), F.lit("</p></article><footer>Foot</footer></body></html>"))
    got = _docs(spark, d).select("doc_id", html.pages(F.concat(head, body), url, NOW_PAGES).alias("p"))
    return got.select("doc_id", *(F.col(f"p.{c}").alias(c) for c in ("title", "published_at", "date_source", "date_confidence", "is_article", "text")))


@query(
    f"""SELECT doc_id, '<h2>Head</h2><p>' || repeat('{_FILL}', 9) || '<a href="https://s.example/d/' || doc_id || '">on</a> <a>bad</a></p><figure><img src="https://s.example/i' || doc_id || '.png"/><figcaption>Seen</figcaption></figure>' AS html,
['https://s.example/i' || doc_id || '.png'] AS images FROM documents"""
)
def clean_markup(spark, d):
    """Known elements only: real image addresses, absolute links, no scripts, forms, furniture or tracking pictures."""
    configure(spark)
    parts = (
        "<main><h1 class='x' onclick='y'>Head</h1><script>z()</script><p style='a'>", _FILL * 9, "<a href='/d/{id}' rel='x'>on</a> <a href='javascript:x()'>bad</a></p>",
        "<div class='share-bar'>Share</div><form><input></form><p> </p><img width='1' height='1' src='/pixel.gif'>",
        "<div class='wp-caption'><img src='data:x' data-src='/i{id}.png' srcset='/s.png 1x' class='y'><p class='wp-caption-text'>Seen</p></div></main>",
    )
    page = F.replace(F.lit("".join(parts)), F.lit("{id}"), F.col("doc_id").cast("string"))
    return _docs(spark, d).select("doc_id", html.pages(page, F.lit("https://s.example/a"), NOW_PAGES).alias("p")).select("doc_id", "p.html", "p.images")


@query("SELECT doc_id, '<i>x</i><sup>' || doc_id || '</sup> = (a + b)/' || doc_id AS formula, '<p>One ' || doc_id || '</p><p>Two<br>lines</p>' AS parts FROM documents")
def formulas_and_parts(spark, d):
    configure(spark)
    i = F.col("doc_id").cast("string")
    formula = F.replace(F.lit("<math><msup><mi>x</mi><mn>#</mn></msup><mo>=</mo><mfrac><mrow><mn>a</mn><mo>+</mo><mn>b</mn></mrow><mn>#</mn></mfrac></math>"), F.lit("#"), i)
    return _docs(spark, d).select("doc_id", html.mathml(formula).alias("formula"), html._text_udf(html.paragraphise)(_id("One ", "<br><br/>\n<br> Two<br>lines<br><br> ")).alias("parts"))


@query(
    f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<p>' || repeat('{_FILL}', 3) || '</p>' WHEN 1 THEN '<p>No ' || doc_id || '</p>' WHEN 2 THEN '<p>Kept ' || doc_id || '</p>' ELSE '<p>' || repeat('{_FILL}', 9) || '</p>' END AS html,
CASE WHEN doc_id % 4 IN (1, 2) THEN 'empty' ELSE 'ok' END AS status, CASE doc_id % 4 WHEN 2 THEN 'file' WHEN 3 THEN 'direct' ELSE 'api' END AS source FROM documents"""
)
def platform_bodies(spark, d):
    """A posts API's body with text, one without, a book's part as it is, and a page's main element."""
    configure(spark)
    k = (F.col("doc_id") % 4 + 1).cast("int")
    platform = F.element_at(F.array(*map(F.lit, ("wordpress", "ghost", "epub", "generic"))), k)
    body = F.element_at(F.array(F.lit(f"<p>{_FILL * 3}</p><script>x</script>"), _id("<p>No ", "</p>"), _id("<p>Kept ", "</p>"), F.lit(None).cast("string")), k)
    page = F.lit(f"<body><nav>Menu</nav><article><p>{_FILL * 9}</p></article></body>")
    return _docs(spark, d).select("doc_id", content.content(platform, body, page, F.lit("https://s.example/")).alias("x")).select("doc_id", "x.*")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 9 WHEN 1 THEN 33 ELSE CASE WHEN doc_id % 2 = 0 THEN 9 ELSE 57 END END AS at FROM documents")
def located_by_context(spark, d):
    """A quote that stands three times: told by what is before it, by what is after it, or by the stored place."""
    configure(spark)
    body = F.lit("aaaa one  quote bbbb four.  cc two  quote dddd five. zz six  quote eeee")
    k, even = F.col("doc_id") % 3, F.col("doc_id") % 2 == 0
    got = anchors.located(body, F.lit("quote"), F.when(k == 1, "two").otherwise(""), F.when(k == 0, "bbbb").otherwise(""), F.when(even, 0).otherwise(1000))
    return _docs(spark, d).select("doc_id", got.alias("at"))


# Sites.


def _sites(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, i = F.col("doc_id") % 10, F.col("doc_id").cast("string")
    base = F.concat(F.lit("https://s"), i, F.lit(".example"))
    rows = _docs(spark, d).select("doc_id", k.alias("k"), base.alias("base"))
    paths = F.when(F.col("k") == 2, "/blog/").when(F.col("k") == 3, "/essays-of-mine").when(F.col("k") == 8, "/mirror.xml").otherwise("")
    sites = rows.select(F.col("doc_id").alias("site"), F.when(F.col("k") == 9, F.concat(F.lit("www.known.example/"), F.col("doc_id").cast("string"))).when(F.col("k") == 0, F.substring("base", 9, 100)).otherwise(F.concat("base", paths)).alias("url"))

    def page(when, path, body, status=200):
        url = F.concat(F.col("base"), F.lit(path)) if isinstance(path, str) else path
        return F.when(when, F.struct(url.alias("url"), F.lit(status).cast("int").alias("status"), (F.lit(body) if isinstance(body, str) else body).alias("body")))

    key = F.lpad(F.hex("doc_id"), 26, "a")
    origin = F.concat(F.lit("https://o"), F.col("doc_id").cast("string"), F.lit(".example"))
    made = [
        page(F.col("k") == 7, "", F.lit(None).cast("string"), None),
        page(~F.col("k").isin(7, 8, 9), "", F.concat(F.lit("<html><head><title>Site "), F.col("doc_id").cast("string"), F.lit(" | a motto</title><link type='application/rss+xml' href='/f.xml'></head>"), F.when(F.col("k") == 1, F.concat(F.lit("<script src='/ghost/x.js' data-key=\"1\"></script><script>{key: '"), F.lower(key), F.lit("'}</script>"))).otherwise(""), F.lit("</html>"))),
        page(F.col("k") == 0, "/wp-json/wp/v2/posts?per_page=1", ' [{"id": 1}]'),
        page(F.col("k") == 3, "/essays-of-mine", "<title>Essays - Site</title>"),
        page(F.col("k") == 3, "/wp-json/wp/v2/posts?per_page=1", "[]"),
        page(F.col("k") == 4, "/robots.txt", F.concat(F.lit("User-agent: *\nSitemap: "), "base", F.lit("/own.xml"))),
        page(F.col("k") == 4, "/own.xml", "<urlset>"),
        page(F.col("k") == 5, "/wp-sitemap.xml", "<?xml?><sitemapindex>"),
        *(page(F.col("k") == 6, p, "gone", 404) for p in detection.SITEMAP_PATHS),
        page(F.col("k") == 8, "/mirror.xml", F.concat(F.lit("<rss><channel><link>"), origin, F.lit("</link>"))),
        page(F.col("k") == 8, F.concat(origin, F.lit("/?rest_route=/wp/v2/posts&per_page=1")), "[]"),
        page(F.col("k") == 8, origin, "<meta content='Origin' property='og:site_name'>"),
    ]
    return sites, rows.select(F.explode(F.array_compact(F.array(*made))).alias("x")).select("x.*")


@query(
    """SELECT doc_id AS site, CASE WHEN doc_id % 10 IN (0, 8) THEN 'wordpress' WHEN doc_id % 10 = 1 THEN 'ghost' WHEN doc_id % 10 = 9 THEN 'essay' WHEN doc_id % 10 <> 7 THEN 'generic' END AS plugin,
CASE doc_id % 10 WHEN 3 THEN 'Essays' WHEN 7 THEN NULL WHEN 8 THEN 'Origin' WHEN 9 THEN 'Known' ELSE 'Site ' || doc_id END AS name,
CASE doc_id % 10 WHEN 7 THEN NULL WHEN 8 THEN 'https://o' || doc_id || '.example' WHEN 9 THEN 'https://www.known.example' ELSE 'https://s' || doc_id || '.example' END AS homepage,
CASE doc_id % 10 WHEN 0 THEN 'https://s' || doc_id || '.example/wp-json/wp/v2' WHEN 8 THEN 'https://o' || doc_id || '.example/?rest_route=/wp/v2' END AS api_root,
CASE doc_id % 10 WHEN 1 THEN lower(lpad(printf('%X', doc_id), 26, 'a')) END AS content_key,
CASE doc_id % 10 WHEN 2 THEN '/blog/' WHEN 3 THEN '/essays-of-mine/' END AS index, CASE doc_id % 10 WHEN 3 THEN '/essays-of-mine' END AS path_prefix,
CASE doc_id % 10 WHEN 4 THEN 'https://s' || doc_id || '.example/own.xml' WHEN 5 THEN '/wp-sitemap.xml' WHEN 6 THEN '' END AS sitemap,
CASE doc_id % 10 WHEN 6 THEN '2026-01-01' END AS hints_checked,
CASE WHEN doc_id % 10 IN (2, 3, 4, 5, 6) THEN 'https://s' || doc_id || '.example/f.xml' WHEN doc_id % 10 = 8 THEN 'https://s' || doc_id || '.example/mirror.xml' WHEN doc_id % 10 = 9 THEN '/rss.xml' END AS feed,
CASE WHEN doc_id % 10 <> 7 THEN doc_id % 10 = 6 END AS partial, CASE WHEN doc_id % 10 = 7 THEN 's' || doc_id || '.example gives no answer' END AS error FROM documents"""
)
def detected_routes(spark, d):
    """Ten kinds of site: posts API, content API, listing, section, sitemaps, none, a dead host, a pasted feed, a recipe."""
    configure(spark)
    recipes = {"known.example": {"plugin": "essay", "name": "Known", "config": {"feed": "/rss.xml"}}}
    got = detection.detect(*_sites(spark, d), recipes, date(2026, 1, 1))
    options = F.from_json("config", "map<string,string>")
    names = ("api_root", "content_key", "index", "path_prefix", "sitemap", "hints_checked", "feed")
    return got.select("site", "plugin", "name", "homepage", *(options[k].alias(k) for k in names), "partial", "error")


@query("SELECT doc_id AS site, CASE doc_id % 4 WHEN 0 THEN 'https://s.example/own.xml' WHEN 1 THEN 'https://s.example/f.xml' WHEN 2 THEN 'https://s' || doc_id || '.example/rss' END AS feed FROM documents")
def found_feeds(spark, d):
    """A stored hint, a link of the home page, a usual place, or none."""
    k, i = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    base = F.when(k < 2, "https://s.example").otherwise(F.concat(F.lit("https://s"), i, F.lit(".example")))
    sites = _docs(spark, d).select(F.col("doc_id").alias("site"), base.alias("base"), F.when(k == 1, "<link href='f.xml' type='application/atom+xml'>").otherwise("<p>").alias("home"), F.when(k == 0, "/own.xml").when(k == 3, "").alias("stored"))
    pages = sites.where("site % 4 >= 2").select(F.explode(F.array(*(F.struct(F.concat("base", F.lit(p)).alias("url"), F.lit(n).alias("status"), F.lit(b).alias("body")) for p, n, b in (("/feed", 404, "<rss>"), ("/rss.xml", 200, "<rss>"), ("/rss", 200, "<?xml?><feed>"))))).alias("x")).select("x.*")
    return detection.find_feed(sites, pages)


@query("SELECT DISTINCT 'https://s.example/' || x AS guid FROM (SELECT doc_id % 700 AS x FROM documents UNION SELECT doc_id % 900 FROM documents) WHERE x % 5 <> 0")
def enumerated_site(spark, d):
    """Sitemap and index together, without denied paths and what is settled."""
    i, one = F.col("doc_id"), _docs(spark, d)
    at = lambda n, tail="": F.concat(F.lit("https://s.example/"), (i % n).cast("string"), F.lit(tail)).alias("url")
    own = one.select("site", at(700))
    denied = one.select("site", F.concat(F.lit("https://s.example/draft/"), i.cast("string")).alias("url"))
    settled = one.where("doc_id % 5 = 0").select(at(900)).union(one.where("doc_id % 5 = 0").select(at(700))).select(urls.canonical_url(F.col("url")).alias("guid"))
    return feeds.enumerated(own.unionByName(denied), one.select("site", at(900, "/")), "^/draft/", settled).select("guid")


# Books.


def _books(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    container = "<container><rootfiles><rootfile full-path='o/b.opf'/></rootfiles></container>"
    for ids, words in parts:
        out = []
        for i, n in zip(ids, words, strict=True):
            opf = f"<package><metadata><title>Book {i}</title></metadata><manifest><item id='n' href='nav.xhtml' properties='nav'/><item id='c' href='cover.xhtml'/><item id='a' href='a.xhtml'/><item id='s' href='../../s.xhtml'/></manifest><spine><itemref idref='c'/><itemref idref='a'/><itemref idref='n' linear='no'/></spine></package>"
            nav = "<html><body><nav epub:type='toc'><ol><li><a href='cover.xhtml'>Cover</a></li><li><a href='a.xhtml#x'>First</a><ol><li><a href='a.xhtml#y'>Second</a></li></ol></li></ol></nav></body></html>"
            files = {"META-INF/container.xml": container, "o/b.opf": opf, "o/nav.xhtml": nav, "o/cover.xhtml": "<html><body><p>Small</p></body></html>", "o/a.xhtml": f"<html><body><div id='x'><p>{'wort ' * n}</p></div><div id='y'><p>Zwei <b>{i}</b></p></div></body></html>"}
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w") as z:
                for name, data in files.items():
                    z.writestr(name, data)
            out.append(packed.getvalue() if i % 7 else b"no book")
        yield pd.Series(out)


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS path, 'Book ' || doc_id AS book_title, unnest([0, 1, 2]) AS position, unnest(['Cover', 'First', 'Second']) AS title, unnest([0, 0, 1]) AS depth, unnest([1, doc_id % 50 + 1, 2]) AS words, unnest([TRUE, FALSE, FALSE]) AS front, NULL AS error FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, 'not a book' FROM documents WHERE doc_id % 7 = 0"""
)
def book_chapters(spark, d):
    """Books with a cover, and a file cut in two at the anchors of its table of contents; every seventh file is no book."""
    configure(spark)
    files = _docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), F.pandas_udf(_books, "binary")("doc_id", F.col("doc_id") % 50 + 1).alias("content"))
    rows = epub.read_books(files)
    return rows.select("path", "book_title", "position", "title", "depth", F.col("words").cast("long").alias("words"), "front", "error")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 3 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def changed_books(spark, d):
    files = _docs(spark, d).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    known = files.where("doc_id % 3 = 0").select(F.sha2("content", 256).alias("sha256"))
    return epub.changed(files.where("doc_id % 3 = 1"), known).select("doc_id", "sha256")


@query("SELECT doc_id AS article_id, CASE doc_id % 3 WHEN 0 THEN 'move' WHEN 1 THEN 'keep' ELSE 'delete' END AS action, CASE doc_id % 3 WHEN 0 THEN doc_id + 1000000 END AS target, doc_id % 100 + CASE doc_id % 3 WHEN 1 THEN 1000000 ELSE 0 END AS source_order FROM documents")
def moved_chapters(spark, d):
    """A new edition: what keeps its title moves, what a reader has marked stays at the end, the rest goes."""
    configure(spark)
    i = F.col("doc_id")
    old = _docs(spark, d).select(i.alias("article_id"), (i % 20).alias("source_id"), _id("Part  ").alias("title"), (i % 100).alias("source_order"))
    new = old.where("article_id % 3 = 0").select(F.col("article_id") + 1_000_000, "source_id", F.upper(F.regexp_replace("title", " +", " ")), F.col("source_order") + 1).toDF(*old.columns)
    return upsert.vanished(old, new, old.where("article_id % 3 = 1").select("article_id"))


# Pictures, files, lines.


@query("SELECT url, min(doc_id) AS article_id FROM (SELECT doc_id, '/p' || doc_id % 300 AS url FROM documents UNION ALL SELECT doc_id, '/q' || doc_id FROM documents) WHERE url NOT IN (SELECT '/p' || doc_id % 300 FROM documents WHERE doc_id % 300 < 50) GROUP BY 1")
def wanted_images(spark, d):
    own = _docs(spark, d)
    i = F.col("doc_id")
    body = F.concat(F.lit("<img src='/p"), (i % 300).cast("string"), F.lit("'><img src='data:x'><img alt=a src=\"/q"), i.cast("string"), F.lit('">'))
    stored = own.where(i % 300 < 50).select(F.concat(F.lit("/p"), (i % 300).cast("string")).alias("url"))
    return upsert.images_wanted(own.select(i.alias("article_id"), body.alias("content_html")), stored.distinct())


@query("SELECT min(doc_id) AS doc_id, CAST(doc_id % 400 AS VARCHAR) AS digest FROM documents WHERE doc_id % 400 >= 30 GROUP BY doc_id % 400")
def new_images(spark, d):
    own = _docs(spark, d).select("doc_id", (F.col("doc_id") % 400).cast("string").alias("digest"))
    return upsert.first_of_digest(own, own.where(F.col("digest").cast("int") < 30).select("digest").distinct(), "doc_id")


@query("SELECT DISTINCT doc_id, sha256('GIF89a' || text) AS digest, CAST(strlen(text) + 6 AS BIGINT) AS bytes FROM documents WHERE strlen(text) + 6 >= 900")
def stored_images(spark, d):
    """Texts as pictures (equal texts are one): what the store lists, with the size of the file that is there."""
    configure(spark)
    path = shared_folder(spark)
    own = spark.read.parquet(f"{d}/documents.parquet").where("text IS NOT NULL")
    images.store(own.select(F.col("doc_id").cast("string").alias("url"), F.lit("text/plain").alias("mime"), F.encode(F.concat(F.lit("GIF89a"), "text"), "UTF-8").alias("body")), path)
    listed = images.stored(spark, path).select(F.col("url").cast("long").alias("doc_id"), "digest", "relpath").distinct()
    return listed.join(images.files(spark, path), "relpath").select("doc_id", "digest", "bytes")


@query("SELECT doc_id, CASE WHEN doc_id % 8 = 7 THEN NULL ELSE ['png', 'jpg', 'gif', 'webp', 'svg', 'avif', NULL][doc_id % 8 + 1] END AS kind FROM documents")
def image_kinds(spark, d):
    """By how a file begins, else by its declared type; a file that is too small is none."""
    k = (F.col("doc_id") % 8 + 1).cast("int")
    starts = ("89504E470D0A1A0A", "FFD8FFE0", "474946383961", "524946460000000057454250", "3C737667", "00000000", "00", "89504E470D0A1A0A")
    types = ("text/x", "image/png", None, "x", "image/svg+xml; charset=utf-8", " Image/AVIF ", "text/html", "image/png")
    pick = lambda xs: F.element_at(F.array(*(F.lit(x).cast("string") for x in xs)), k)
    body = F.unhex(F.concat(pick(starts), F.repeat(F.lit("00"), F.when(k == 8, 10).otherwise(900))))
    return _docs(spark, d).select("doc_id", text.sniff_image(body, pick(types)).alias("kind"))


@query("SELECT doc_id, 'é ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' gepackt' ELSE '' END AS decoded FROM documents")
def packed_bytes(spark, d):
    """Bodies in gzip, deflate or none of these; in UTF-8 or a western single-byte set."""
    configure(spark)

    @F.pandas_udf("binary")
    def packed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import gzip
        import zlib

        for ids in parts:
            yield pd.Series([gzip.compress(f"é {i} gepackt".encode()) if i % 4 == 0 else zlib.compress(f"é {i} gepackt".encode()) if i % 2 == 0 else f"é {i}".encode("latin-1") for i in ids])

    coding = F.when(F.col("doc_id") % 4 == 0, "gzip").when(F.col("doc_id") % 2 == 0, "Deflate").otherwise("")
    return _docs(spark, d).select("doc_id", bytes_text.decoded(packed("doc_id"), F.lit("text/html; charset=ISO-8859-1"), coding).alias("decoded"))


@query("SELECT doc_id, 'https://e.com/' || repeat('a', 81) || '…' AS elided, 'https://e.com/%C3%A9?x=' || doc_id AS coded, CASE doc_id % 3 WHEN 0 THEN 'This page is gone from its site.' WHEN 1 THEN 'The text could not be fetched.' END AS notice FROM documents")
def shown_addresses(spark, d):
    status = F.when(F.col("doc_id") % 3 == 0, "gone").when(F.col("doc_id") % 3 == 1, "error").otherwise("ok")
    long = F.concat(F.lit("https://e.com/"), F.repeat(F.lit("a"), 81), F.lit("%C"), _id("3"), F.repeat(F.lit("b"), 40))
    return _docs(spark, d).select("doc_id", urls.elide(long).alias("elided"), urls.ascii_safe(_id("https://e.com/é?x=")).alias("coded"), text.status_notice(status).alias("notice"))


@query("SELECT doc_id, ['one ' || doc_id, 'two', 'four'] AS senses, ['noun', 'noun', 'verb'] AS parts, 'said so' AS example FROM documents")
def dictionary_senses(spark, d):
    """Two senses of a meaning at most, each once, without markup."""
    sense = lambda words, *examples: f'{{"definition": "{words}", "examples": [{", ".join(examples)}]}}'
    noun = ", ".join((sense("<b>one</b>  #", '""', '"<i>said</i> so"'), sense(""), sense("two"), sense("three")))
    payload = F.replace(F.lit(f'{{"en": [{{"partOfSpeech": "noun", "definitions": [{noun}]}}, {{"partOfSpeech": "verb", "definitions": [{sense("TWO")}, {sense("four")}]}}]}}'), F.lit("#"), F.col("doc_id").cast("string"))
    got = _docs(spark, d).select("doc_id", text.definitions(payload).alias("x"))
    return got.select("doc_id", F.col("x.text").alias("senses"), F.col("x.part").alias("parts"), F.get("x.example", 0).alias("example"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 0 AND doc_id % 100 >= 2 THEN 60 * (1 - doc_id % 100 / 100.0) / (doc_id % 100 / 100.0) END AS eta, doc_id % 30 < 7 AND doc_id % 11 <> 0 AS fresh FROM documents")
def run_estimates(spark, d):
    """Time left of a run, and whether a stored hint still counts."""
    i = F.col("doc_id")
    stamp = F.when(i % 11 == 0, "no date").otherwise(F.date_format(F.expr("timestamp_ntz'2024-01-31 00:00:00' - make_dt_interval(CAST(doc_id % 30 AS INT))"), "yyyy-MM-dd"))
    return _docs(spark, d).select("doc_id", schedule.eta(F.lit(60), i % 100 / 100.0, i % 4 == 0).alias("eta"), schedule.hint_fresh(stamp, NOW).alias("fresh"))


@query("SELECT CASE WHEN source_id % 9 <> 0 THEN '  ' ELSE '- ' END || rpad(source_name, 24, ' ') || lpad(CASE WHEN source_id = 0 THEN '0' ELSE CAST(source_id AS VARCHAR) || ' 000' END, 9, ' ') AS line FROM fx_sources")
def source_lines(spark, d):
    return sinks.source_lines(view(spark, d, "fx_sources").withColumn("articles", F.col("source_id") * 1000))


@query("SELECT rpad(CASE date_precision WHEN 'unknown' THEN '—' WHEN 'year' THEN coalesce(strftime(published_at, '%Y'), '—') WHEN 'month' THEN coalesce(strftime(published_at, '%Y-%m'), '—') ELSE coalesce(strftime(published_at, '%Y-%m-%d'), '—') END, 10, ' ') AS date, rpad(source_name, 18, ' ') AS source, title[1:64] AS title FROM fx_articles a JOIN fx_sources s ON a.source_id = s.source_id")
def queue_lines(spark, d):
    return sinks.queue_lines(view(spark, d, "fx_articles").join(view(spark, d, "fx_sources"), "source_id"))


# Runs.


@query(
    f"""WITH x AS (SELECT doc_id, doc_id % 7 AS source_id, CASE WHEN doc_id % 10 <> 3 THEN {_AT} END AS posted FROM documents),
v0 AS (SELECT * FROM x WHERE doc_id % 2 = 0), f0 AS (SELECT source_id, max(posted) - INTERVAL 2 DAY AS floor FROM v0 GROUP BY 1),
new1 AS (SELECT x.* FROM x LEFT JOIN f0 ON x.source_id = f0.source_id WHERE doc_id % 4 = 1 AND (posted IS NULL OR floor IS NULL OR posted >= floor)),
v1 AS (SELECT * FROM v0 UNION ALL SELECT * FROM new1), f1 AS (SELECT source_id, max(posted) - INTERVAL 2 DAY AS floor FROM v1 GROUP BY 1),
new2 AS (SELECT x.* FROM x LEFT JOIN f1 ON x.source_id = f1.source_id WHERE doc_id % 4 = 3 AND (posted IS NULL OR floor IS NULL OR posted >= floor))
SELECT doc_id, source_id, posted AS published_at, CASE WHEN doc_id % 4 = 2 THEN 'Second' ELSE 'First' END AS title FROM (SELECT * FROM v1 UNION ALL SELECT * FROM new2)"""
)
def incremental_runs(spark, d):
    """Two runs over files of candidates: known ones are updated, new ones admitted from the floor of each run on."""
    i, folder = F.col("doc_id"), shared_folder(spark)
    rows = _docs(spark, d).select((i % 7).alias("source_id"), i.cast("string").alias("guid"), F.lit("First").alias("title"), F.when(i % 10 != 3, F.col("at")).alias("published_at"), F.lit("exact").alias("date_confidence"), i.alias("pos"))
    parts.create(rows.where("pos % 2 = 0").drop("pos"), f"{folder}/archive", 16)
    second = rows.where("pos % 4 = 2").withColumn("title", F.lit("Second"))
    batches = 0
    for arrived in (rows.where("pos % 4 = 1"), rows.where("pos % 4 = 3").unionByName(second)):
        arrived.coalesce(1).write.mode("append").parquet(f"{folder}/incoming")
        batches += incremental.run_once(spark, f"{folder}/incoming", rows.schema, f"{folder}/archive", f"{folder}/checkpoint")
    return parts.read(spark, f"{folder}/archive", batches).select(F.col("guid").cast("long").alias("doc_id"), "source_id", "published_at", "title")


@query("SELECT DISTINCT user_id AS source_id, event_id % 40 AS post FROM events")
def arrivals_once(spark, d):
    """Announcements in the order of their time, by several routes and in two runs of a stream: each post of a source comes out once."""
    folder, rows = shared_folder(spark), spark.read.parquet(f"{d}/events.parquet")
    rows = rows.select(F.col("user_id").alias("source_id"), (F.col("event_id") % 40).cast("string").alias("guid"), F.col("ts").cast("timestamp_ntz").alias("at"))
    for k in range(4):
        # Restarted from its checkpoint after the second file.
        rows.where(F.pmod(F.dayofyear("at"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(f"{folder}/incoming")
        if k % 2:
            stateful.keep_state(spark)
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/incoming")
            out = stateful.once(stream, "at", "1000 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
            out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("source_id", F.col("guid").cast("long").alias("post"))


@query(
    f"""WITH x AS (SELECT doc_id, doc_id % 7 AS source_id, doc_id % 8 = 5 AS known, CASE WHEN doc_id % 3 = 0 THEN {_AT} END AS posted, CASE WHEN doc_id % 4 < 2 THEN 1 ELSE 2 END AS run FROM documents WHERE doc_id % 8 <> 7),
f AS (SELECT source_id, max(posted) - INTERVAL 30 DAY AS floor FROM x WHERE known GROUP BY 1),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY run, source_id ORDER BY doc_id % 4, doc_id) AS rk FROM x WHERE posted IS NULL AND NOT known)
SELECT x.doc_id, x.source_id, x.run FROM x LEFT JOIN f ON x.source_id = f.source_id LEFT JOIN u ON x.doc_id = u.doc_id
WHERE known OR (posted IS NOT NULL AND (floor IS NULL OR posted >= floor)) OR (x.source_id > 0 AND rk <= 3 * x.source_id)"""
)
def undated_allowance(spark, d):
    """What two runs of two batches each take: known posts, dated ones from a floor on, and of each source the run's first undated ones up to its limit."""
    i, folder = F.col("doc_id"), shared_folder(spark)
    rows = _docs(spark, d).where(i % 8 != 7).select((i % 7).alias("source_id"), i.cast("string").alias("guid"), F.when(i % 3 == 0, F.col("at")).alias("published_at"), i.alias("pos"))
    known = rows.where("pos % 8 = 5")
    floor = known.groupBy("source_id").agg((F.max("published_at") - F.expr("INTERVAL '30' DAY")).alias("floor"))
    limits = spark.createDataFrame([(k, 3 * k) for k in range(1, 7)], "source_id long, n long")
    for k in range(4):
        rows.where(F.col("pos") % 4 == k).coalesce(1).write.mode("append").parquet(f"{folder}/incoming")
        if k % 2:
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/incoming")
            taken = stateful.admitted(stream, known, floor, limits, k // 2 + 1).withColumn("run", F.lit(k // 2 + 1))
            taken.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("guid").cast("long").alias("doc_id"), "source_id", "run")


@query(
    f"""WITH x AS (SELECT doc_id, doc_id % 4 AS site, {_AT} AS posted, (row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id DESC) - 1) // 7 + 1 AS page FROM documents),
e AS (SELECT site, page FROM x GROUP BY ALL HAVING bool_and(CASE WHEN site % 2 = 0 THEN doc_id % 40 < 32 AND page > 2 ELSE posted < TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(100 + 20 * site AS INTEGER)) END)),
s AS (SELECT site, min(page) AS last FROM e GROUP BY 1)
SELECT x.doc_id, x.site, CAST(x.page AS INTEGER) AS page FROM x LEFT JOIN s ON x.site = s.site WHERE s.last IS NULL OR x.page <= s.last"""
)
def pages_until_old(spark, d):
    """Pages of seven posts that a stream asks four sites for, up to the first page of which all is known (even sites) or older than the floor (odd ones)."""
    i, folder = F.col("doc_id"), shared_folder(spark)
    at = Window.partitionBy(i % 4).orderBy(i.desc())
    rows = _docs(spark, d).select(i, (i % 4).alias("site"), "at", (F.floor((F.row_number().over(at) - 1) / 7) + 1).cast("int").alias("page"))
    listed = rows.select("site", "page", _id("https://s.example/").alias("link"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.lit("").alias("title"))
    pages.write_pages(listed, f"{folder}/sites")
    place = f"{folder}/sites/site=".removeprefix("file://")
    known = rows.where("site % 2 = 0 AND doc_id % 40 < 32 AND page > 2").select(F.concat(F.lit(place), F.col("site").cast("string")).alias("site"), _id("https://s.example/").alias("url"))
    known.repartitionByRange("site", "url").sortWithinPartitions("site", "url").write.parquet(f"{folder}/known")
    floors = {f"{place}{k}": (datetime(2020, 1, 1) + timedelta(days=100 + 20 * k)).isoformat() for k in (1, 3)}
    how = {"plugin": "parquet_pages", "path": ",".join(f"{place}{k}" for k in range(4)), "notes": f"{folder}/notes".removeprefix("file://"), "known": f"{folder}/known".removeprefix("file://"), "floors": json.dumps(floors)}
    got = pages.read_run(spark, f"{folder}/out", f"{folder}/checkpoint", **how)
    return got.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("doc_id"), F.regexp_extract("site", r"(\d+)$", 1).cast("long").alias("site"), "page")
