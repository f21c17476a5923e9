"""Dates, URLs, text, bytes, HTML, feeds, books, plug-ins and incremental runs on small inputs."""

import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inkstream.functions import anchors, bytes_text, dates, html, html_tree, text, urls
from inkstream.sources import epub, feeds, plugins
from inkstream.streaming import incremental, parts

NOW = datetime(2026, 9, 5, 12)


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "iso", "precision"),
    [
        ("Thu, 16 Apr 2026 17:25:38 +0000", datetime(2026, 4, 16, 17, 25, 38), "day"), ("2024-02-29T10:00:00+02:00", datetime(2024, 2, 29, 8), "day"), ("2023-02-29", None, "unknown"), ("March 13, 2019", datetime(2019, 3, 13), "day"),
        ("5 March 2004", datetime(2004, 3, 5), "day"), ("March 2004", datetime(2004, 3, 1), "month"), ("written in 1997", datetime(1997, 1, 1), "year"), ("1969-01-01", None, "unknown"), ("2027-01-01", None, "unknown"), ("", None, "unknown"),
        ("posted 2020-01-02 03:04", datetime(2020, 1, 2, 3, 4), "day"), ("Sept 3rd, 2020", datetime(2020, 9, 3), "day"),
    ],
)
def test_dates(spark, raw, iso, precision):
    got = one(spark, raw, lambda c: dates.parse_rfc822(c, NOW))
    assert (got.iso, got.precision) == (iso, precision)


def test_date_forms(spark):
    got = one(spark, "https://x.example/2020/13/a", lambda c: dates.parse_from_url(c, NOW))
    assert got.iso is None
    got = one(spark, "https://x.example/2020/05/06/slug", lambda c: dates.parse_from_url(c, NOW))
    assert (got.iso, got.precision, got.confidence) == (datetime(2020, 5, 6), "day", "high")
    year = one(spark, "in 1997", lambda c: dates.parse_freeform(c, NOW))
    assert (year.confidence, year.source) == ("inferred", "text:year-only")


def test_listing_dates(spark):
    rows = [("p", 1, "09/19"), ("p", 2, "03/20"), ("p", 3, "05/20"), ("q", 1, "09/19"), ("q", 2, "03/18"), ("q", 3, "05/20"), ("r", 1, "2 May 2019"), ("r", 2, "in 1999 or so"), ("r", 3, "1999")]
    got = {(r.page_url, r.pos): r.published_at for r in dates.listing_dates(spark.createDataFrame(rows, "page_url string, pos long, hint string"), NOW).collect()}
    assert got["p", 1] == datetime(2019, 9, 1) and got["q", 1] is None and got["r", 1] == datetime(2019, 5, 2) and got["r", 2] is None and got["r", 3] == datetime(1999, 1, 1)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://www.Example.com/Path/?utm_source=x&b=2&ref=1#frag", "https://example.com/Path?b=2"), ("https://example.com", "https://example.com/"), ("https://example.com:443//", "https://example.com"), ("https://e.com/a?x=&y=1", "https://e.com/a?y=1"),
        ("https://e.com/a?referrer=1&mc_id=2&q=a+b", "https://e.com/a?q=a+b"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, url, urls.canonical_url) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://e.com/", "skip"), ("https://e.com/?p=12", "maybe"), ("https://e.com/?s=x", "skip"), ("https://e.com/a.PDF", "skip"), ("https://e.com/2020/05/", "skip"), ("https://e.com/archive/2020/05/06/slug", "maybe"), ("https://e.com/archive/2020/05/06/7", "skip"), ("https://e.com/tag/x", "skip"), ("https://e.com/post", "maybe")],
)
def test_classify_url(spark, url, want):
    assert one(spark, url, lambda c: urls.classify_url(c, NOW)) == want


def test_ascii_safe(spark):
    assert one(spark, "https://e.com/é b?q=ü&x=%20", urls.ascii_safe) == "https://e.com/%C3%A9 b?q=%C3%BC&x=%20"
    assert one(spark, "https://e.com/a", urls.ascii_safe) == "https://e.com/a"


def test_text(spark):
    assert one(spark, "a" * 300, text.make_excerpt) == "a" * 260 + "…"
    assert one(spark, "it\x92s", text.repair_c1) == "it’s" and one(spark, "\x81", text.repair_c1) == "\x81"
    assert one(spark, "A long title | My Site", text.clean_title) == "A long title" and one(spark, "Post - Blog", lambda c: text.clean_title(c, "Blog")) == "Post" and one(spark, " ", text.clean_title) == "Untitled"
    assert one(spark, "a b", text.word_count) == 2
    assert one(spark, "“Don’t”", text.headword) == "don't" and one(spark, "two words", text.headword) is None and one(spark, "Anna's", text.headword) == "anna"
    assert one(spark, json.dumps({"en": [{"partOfSpeech": "n", "definitions": [{"definition": "<b>One</b>"}, {"definition": "one"}, {"definition": "three"}]}]}), lambda c: F.transform(text.definitions(c), lambda d: d["text"])) == ["One"]


def test_bytes():
    assert bytes_text.decode_body("é’".encode(), "text/html; charset=iso-8859-1") == "é’"
    assert bytes_text.decode_body(b"it\x92s", "text/html; charset=latin-1") == "it’s"
    assert bytes_text.decode_body("é".encode()[:1] + b"", None) != ""
    import gzip

    packed = gzip.compress(b"hello world" * 50)
    assert bytes_text.decompress(packed[:-10], "gzip").startswith(b"hello")
    assert bytes_text.crawl_delay("User-agent: *\nCrawl-delay: 5\n\nUser-agent: reader\nCrawl-delay: 2", "reader/1.0") == 2
    assert bytes_text.crawl_delay("User-agent: *\nCrawl-delay: 500", "reader") == 30


def test_locate(spark):
    assert anchors.locate("a  b a b", "a b", "", "", 5) == 4
    assert anchors.locate("one cat two cat", "cat", "two ", "", 0) == 12 and anchors.locate("x", "y") is None
    assert one(spark, "a  quote here", lambda c: anchors.located(c, F.lit("quote"), F.lit(""), F.lit(""), F.lit(0))) == 2


PAGE = """<html><head><title>T | S</title><meta property="article:published_time" content="2020-01-02T00:00:00Z"></head><body><nav><a href=/>home</a></nav>
<article><h1>Head</h1><p onclick="x()">{}</p><img data-src="/i.png" src="/s.gif"><script>bad()</script><a href="javascript:x">l</a></article></body></html>""".format("word " * 120)


def test_page(spark):
    got = spark.createDataFrame([(PAGE, "https://e.com/p")], "h string, u string").select(html.pages(F.col("h"), F.col("u"), NOW).alias("p")).first().p
    assert got.title == "Head" and got.published_at == datetime(2020, 1, 2) and got.date_confidence == "exact"
    assert "script" not in got.html and "onclick" not in got.html and "javascript" not in got.html and 'src="https://e.com/i.png"' in got.html and "<h2>Head</h2>" in got.html
    assert html.mathml_text("<math><mfrac><mi>a</mi><mn>2</mn></mfrac></math>") == "<i>a</i>/2"
    times = html_tree.parse('<time datetime="2020-01-01">a</time><time datetime="2021-01-01">b</time>')
    assert html.page_date(times, "https://e.com/x", NOW).confidence == "medium"
    assert [n.text() for n in html_tree.select(html_tree.parse('<div class="a b"><p id=x>1</p></div><p>2</p>'), ".b p, #y")] == ["1"]


def test_page_extract_of_a_page_that_never_closes_its_elements(spark, tmp_path):
    import __spark_entry__

    n = 2000
    deep = f"<html><body><article><h1>T</h1>{'<p><b>some text &amp; more<br>' * n}</article></body></html>"
    spark.createDataFrame([(1, "https://e.com/p", deep), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in __spark_entry__.queries()["page_extract"](spark, str(tmp_path)).collect()}
    assert got[1].html == "<h2>T</h2>" + "<p><b>some text &amp; more<br/>" * n + "</b></p>" * n
    assert got[1].text == " ".join(["T"] + ["some text & more"] * n) and got[1].title == "T"
    assert (got[2].title, got[2].html, got[2].is_article) == ("Untitled", "", False)


def test_page_texts_are_measured_once_however_deep():
    page = html_tree.parse("<div class=post><p>One, two， three and four and five.<a href=x>six</a><script>no, no</script><a>a<a>b</a></a></p> <p> </p></div>")
    sizes = html_tree.measures(page)
    for x in page.walk():
        m, text = sizes[id(x)], x.text()
        assert (m.length, m.commas, m.linked) == (len(text), text.count(",") + text.count("，"), sum(len(a.text()) for a in x.find("a")))
    deep = html.read_page("<body>" + "<div class=post><p>words, and words, of more than twenty five<b>" * 1000, None, NOW)
    assert deep["html"].count("<p>words") == deep["text"].count("words, and") == 1000


@pytest.mark.parametrize(
    ("part", "want"),
    [
        ('<img src="a.png" width="²">', '<img src="https://e.com/a.png" width="²"/>'),
        ('<img src="a.png" width="012"><i>x</i>', "<i>x</i>"),
        ('<img srcset="a.png 1.2.3x, b.png 1x">', '<img src="https://e.com/b.png"/>'),
        ('<a href="http://[x">l</a>', '<a href="http://[x">l</a>'),
        ('<img src="//[x/a.png">', '<img src="//[x/a.png"/>'),
        ('<time datetime="9999-12-31T23:59:00-05:00">t</time>', '<time datetime="9999-12-31T23:59:00-05:00">t</time>'),
        ("a<![foo bar]>b<![>c", "abc"),
        (f"&#{'9' * 5000};&#{'0' * 5000}65;", "\ufffdA"),
        ('<script type="application/ld+json">{"@type": [{}, 5]}</script>x', "x"),
        ('<script type="application/ld+json">{"@type": true}</script>x', "x"),
        (f'<script type="application/ld+json">{"[" * 100_000}</script>x', "x"),
    ],
)
def test_page_with_a_value_that_cannot_be_read(part, want):
    got = html.read_page(f"<body><article>{part}<p>{'word ' * 100}</p></article></body>", "https://e.com/p", NOW)
    assert got["html"].startswith(want + "<p>word ") and got["published_at"] is None and not got["is_article"]
    assert html.read_page('<article><a href="b">x</a></article>', "http://[x/", NOW)["html"] == '<a href="b">x</a>'


RSS = """<rss><channel><item><title><![CDATA[One &amp; all]]></title><link>https://e.com/1</link><pubDate>Thu, 16 Apr 2020 17:25:38 +0000</pubDate><content:encoded><![CDATA[<p>x</p>]]></content:encoded></item>
<entry ><title>Two</title><link rel="alternate" href="https://e.com/2?a=1&amp;b=2"/><published>2019-01-01T00:00:00Z</published></entry></channel></rss>"""


def test_feeds(spark):
    df = spark.createDataFrame([("s", 1, RSS), ("s", 2, RSS), ("s", 3, RSS.replace("/1<", "/9<"))], "site string, page int, xml string")
    got = feeds.read_feed(df, NOW).orderBy("pos").collect()
    assert [(r.link, r.title, r.date.iso) for r in got] == [("https://e.com/1", "One & all", datetime(2020, 4, 16, 17, 25, 38)), ("https://e.com/2?a=1&b=2", "Two", datetime(2019, 1, 1))]
    assert got[0].html == "<p>x</p>"
    pages = spark.createDataFrame([("r", "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>image-sitemap.xml</loc></sitemap></sitemapindex>"), ("a", "<urlset><url><loc>https://e.com/p</loc><lastmod>2020</lastmod></url></urlset>")], "url string, body string")
    assert [(r.url, r.lastmod) for r in feeds.read_sitemaps(pages, spark.createDataFrame([("s", "r")], "site string, url string")).collect()] == [("https://e.com/p", "2020")]
    assert one(spark, "User-agent: *\nSitemap: https://e.com/s.xml", feeds.robots_sitemaps) == ["https://e.com/s.xml"]
    listing = spark.createDataFrame([("s", 1, "https://e.com/list", '<ul><li><a href="/post-a#x">A</a> 2 May 2019</li><li><a href="/tag/z">t</a></li><li><a href="https://o.org/p">o</a></li></ul>')], "site string, page int, url string, body string")
    found = feeds.read_archive(listing, spark.createDataFrame([], "guid string"), NOW).collect()
    assert [(r.url, r.hint) for r in found] == [("https://e.com/post-a", "2 May 2019")]
    api = spark.createDataFrame([("s", 1, json.dumps([{"id": 1, "link": "https://e.com/p", "date_gmt": "2020-01-01T00:00:00", "status": "publish", "title": {"rendered": "T"}, "content": {"rendered": "<p>b</p>"}}, {"id": 2, "status": "draft"}]))], "site string, page int, body string")
    assert [(r.guid, r.title) for r in feeds.rest_posts(api, NOW).collect()] == [("https://e.com/p", "T")]


def book(bad: str = "") -> bytes:
    out = io.BytesIO()
    body = lambda t, n: f"<html><body><h1>{t}</h1><p>{'word ' * n}</p><img src='i.png'/></body></html>"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="b/p.opf"/></rootfiles></container>')
        z.writestr("b/p.opf", (bad + '<package><metadata><title>Book</title></metadata><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="c" href="copyright.xhtml"/><item id="1" href="one.xhtml"/></manifest><spine><itemref idref="c"/><itemref idref="1"/></spine></package>'))
        z.writestr("b/nav.xhtml", '<html><body><nav epub:type="toc"><ol><li><a href="one.xhtml">One</a></li><li><a href="one.xhtml#two">Two</a></li></ol></nav></body></html>')
        z.writestr("b/copyright.xhtml", body("Copyright", 5))
        z.writestr("b/one.xhtml", f"<html><body><div><h1>One</h1><p>{'a ' * 60}</p><h2 id='two'>Two</h2><p>{'b ' * 60}</p></div></body></html>")
    return out.getvalue()


def test_books(spark):
    rows = epub.read_books(spark.createDataFrame([("ok.epub", bytearray(book())), ("bad.epub", bytearray(book("<!DOCTYPE x [<!ENTITY a 'b'>]>"))), ("no.epub", bytearray(b"junk"))], "path string, content binary")).collect()
    own = sorted((r.position, r.title, r.front, r.words) for r in rows if r.path == "ok.epub")
    assert [(t, f) for _, t, f, _ in own] == [("Copyright", True), ("One", False), ("Two", False)] and own[1][3] == 61
    assert {r.path for r in rows if r.error} == {"bad.epub", "no.epub"}
    assert not epub.safe_name("../x") and epub.resolve("b/p.opf", "../../x") is None and epub.resolve("b/p.opf", "t/x.html#a") == "b/t/x.html"


def test_plugin_source(spark, tmp_path):
    (tmp_path / "page-1.json").write_text(json.dumps([{"link": f"https://e.com/{k}", "title": str(k), "date": f"2020-01-0{9 - k}"} for k in range(3)]))
    (tmp_path / "page-2.json").write_text(json.dumps([{"link": "https://e.com/old", "date": "2010-01-01"}]))
    plugins.install(spark)
    df = spark.read.format("stubs").option("plugin", "json_folder").option("path", str(tmp_path)).load()
    assert df.count() == 4 and df.where(F.col("published_at") >= datetime(2020, 1, 8)).count() == 2
    assert plugins.parse_limit("all") is None and plugins.stored_limit(True) is None and plugins.stored_limit(None) is None and plugins.stored_limit(7) == 7 and plugins.stored_limit(100_001) is None
    with pytest.raises(ValueError):
        plugins.parse_limit("0")


def test_incremental_run(spark, tmp_path):
    kind = "source_id long, guid string, title string, published_at timestamp_ntz, date_confidence string"
    parts.create(spark.createDataFrame([(1, "a", "A", datetime(2020, 1, 10), "high")], kind), f"{tmp_path}/snap")
    rows = [(1, "a", "A2", datetime(2020, 1, 9), "medium", 0), (1, "old", "O", datetime(2020, 1, 1), "high", 1), (1, "new", "N", datetime(2020, 1, 20), "high", 2), (1, "undated", "U", None, "unknown", 3), (2, "x", "X", datetime(2000, 1, 1), "high", 4)]
    new = spark.createDataFrame(rows, kind + ", pos long")
    new.coalesce(1).write.parquet(f"{tmp_path}/in")
    n = incremental.run_once(spark, f"{tmp_path}/in", new.schema, f"{tmp_path}/snap", f"{tmp_path}/check")
    got = {r.guid: r.title for r in parts.read(spark, f"{tmp_path}/snap", n).collect()}
    assert got == {"a": "A2", "new": "N", "undated": "U", "x": "X"}
    assert incremental.run_once(spark, f"{tmp_path}/in", new.schema, f"{tmp_path}/snap", f"{tmp_path}/check") == 0


def test_the_floor_is_that_of_the_last_snapshot(spark, tmp_path):
    kind = "source_id long, guid string, title string, published_at timestamp_ntz, date_confidence string"
    parts.create(spark.createDataFrame([(1, "a", "A", datetime(2020, 1, 10), "high")], kind), f"{tmp_path}/snap")
    batch = lambda *rows: spark.createDataFrame([(1, g, g, at, "high", k) for k, (g, at) in enumerate(rows)], kind + ", pos long").coalesce(1)
    run = lambda: incremental.run_once(spark, f"{tmp_path}/in", batch(("x", None)).schema, f"{tmp_path}/snap", f"{tmp_path}/check")
    batch(("new", datetime(2024, 1, 20))).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == 1 and parts.last(spark, f"{tmp_path}/snap") == 1
    batch(("late", datetime(2021, 5, 1)), ("next", datetime(2024, 1, 19)), ("a", datetime(2020, 1, 11))).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == 1
    got = parts.read(spark, f"{tmp_path}/snap", 2)
    assert sorted(r.guid for r in got.collect()) == ["a", "new", "next"]
    # A snapshot that was not written whole is none, and a batch that is repeated gives the same one.
    (tmp_path / "snap" / "state-3").mkdir()
    assert parts.last(spark, f"{tmp_path}/snap") == 2


def test_interpolated_dates_in_pandas_and_in_columns(spark):
    rows = [(1, 0, datetime(2020, 1, 2, 23)), (1, 1, None), (1, 2, datetime(2020, 1, 1, 23)), (2, 0, None), (2, 1, datetime(2020, 1, 1))]
    df = spark.createDataFrame(rows, "source_id long, pos long, published_at timestamp_ntz")
    for f in (dates.bracket_once, dates.bracket_all):
        got = {(r.source_id, r.pos): r.est for r in f(df).collect()}
        assert got[1, 1] == datetime(2020, 1, 2) and got[2, 0] is None


def test_main_text_takes_the_first_article_and_whole_parents():
    long = lambda w: f"<p>{(w + ' ') * 120}</p>"
    first = html_tree.parse(f"<article>{long('one')}</article><article>{long('two') * 3}</article>")
    assert html.extract_main(first).text().startswith("one")
    deep = html_tree.parse(f"<body><div><div>{long('a，b')}</div><div>{long('c, d')}</div></div><p>short</p></body>")
    assert "a，b" in html.extract_main(deep).text() and "c, d" in html.extract_main(deep).text()


def test_vanished_takes_the_nearest_free_chapter(spark):
    import random

    from inkstream.operators import upsert

    draw = random.Random(3)
    old = [(k, 1, draw.choice("ab"), draw.randint(0, 30)) for k in range(40)]
    new = [(100 + k, 1, draw.choice("ab"), draw.randint(0, 30)) for k in range(25)]
    want = {}
    for t in "ab":
        left = sorted((o, i) for i, _, x, o in new if x == t)
        for o, i in sorted((o, i) for i, _, x, o in old if x == t):
            best = min(left, key=lambda x: (abs(x[0] - o), x), default=None)
            left = [x for x in left if x != best]
            want[i] = best and best[1]
    kind = "article_id long, source_id long, title string, source_order long"
    rows = upsert.vanished(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), spark.createDataFrame([], "article_id long")).collect()
    assert {r.article_id: r.target for r in rows} == want


def test_feed_of_one_entry_and_named_references(spark):
    xml = "<rss><item><title>Caf&eacute; &#233;t&#xE9;</title><link>https://e.com/1</link></item></rss>"
    got = feeds.feed_items(spark.createDataFrame([("s", 1, xml)], "site string, page int, xml string"), NOW).collect()
    assert [(r.title, r.date.iso) for r in got] == [("Café été", None)]



def test_entities_are_refused_in_any_encoding_and_at_any_place():
    declared = "<!DOCTYPE x [<!ENTITY a 'b'>]><x>&a;</x>"
    late = "<!DOCTYPE x [" + f"<!--{'c' * 70_000}-->" + "<!ENTITY % a 'b'>]><x/>"
    for bad in (declared.encode(), ("<?xml version='1.0' encoding='utf-16'?>" + declared).encode("utf-16"), late.encode()):
        with pytest.raises(epub.BadBook, match="entities"):
            epub._xml(bad)
    assert epub._xml(b"<x>&amp;<!-- <!ENTITY a 'b'> --></x>").text == "&"
    with pytest.raises(epub.BadBook, match="bad XML"):
        epub._xml(b"<x>")


def test_names_of_what_stands_around_an_article():
    from inkstream.functions import html

    around = ["siteNav", "nav", "post-navigation", "RelatedPosts", "share-buttons", "comments-area", "gdpr", "footerWidget", "jp-relatedposts", "sr-only"]
    own = ["navy", "entry-content", "context", "railway", "postBody", "preshared", "unrelated"]
    assert all(html.JUNK.search(n) for n in around) and not any(html.JUNK.search(n) for n in own)
    assert html.GOOD.search("entry-content") and not html.GOOD.search("context") and html.BAD.search("header-ad") and not html.BAD.search("header-adobe")


def test_vanished_walks_all_titles_of_a_task_in_one_pass(spark):
    from inkstream.operators import upsert

    kind = "article_id int, source_id long, title string, source_order int"
    old = [(1, 1, "A  b", 5), (2, 1, "a B", 9), (3, 2, "a b", 9), (4, None, None, None), (5, 1, "gone", None), (6, 1, "kept", 2)]
    new = [(11, 1, "a b ", 8), (12, None, None, 7), (13, 1, "other", 1), (14, 2, "a b", 0), (15, 2, "a b", 10)]
    got = upsert.vanished(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), spark.createDataFrame([(6,), (6,), (1,)], "article_id int"))
    rows = {r.article_id: (r.action, r.target, r.source_order) for r in got.collect()}
    assert rows == {1: ("move", 11, 5), 2: ("delete", None, 9), 3: ("move", 15, 9), 4: ("move", 12, None), 5: ("delete", None, None), 6: ("keep", None, 1_000_002)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("MapInArrow") == 1  # one call a batch, not one a title
