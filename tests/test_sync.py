"""Runs, limits, detection anew, content by platform, keyed reads."""

import json
from datetime import datetime

from inkstream.operators import lookup, merge
from inkstream.plans import sync
from inkstream.sources import content

WORDS = "word " * 30


def tables(spark):
    held = [(1, 1, "a", datetime(2020, 1, 1), "old", "ok", 0), (2, 1, "b", datetime(2020, 2, 1), "b", "pending", 1), (3, 2, "z", None, "z", "ok", 0)]
    articles = spark.createDataFrame(held, "article_id long, source_id long, guid string, published_at timestamp_ntz, title string, content_status string, source_order int")
    sources = spark.createDataFrame([(1, "One", True, '{"limit": 2}'), (2, "Two", False, None), (3, "Three", True, "junk")], "source_id long, source_name string, enabled boolean, config string")
    new = [(1, "a", datetime(2020, 1, 1), "new title", 0, None), (1, "c", datetime(2021, 1, 1), "c", 1, None), (1, "d", datetime(2019, 1, 1), "d", 2, None), (2, "y", None, "y", 0, None), (3, None, None, None, None, "no route")]
    candidates = spark.createDataFrame(new, "source_id long, guid string, published_at timestamp_ntz, title string, source_order int, failed string")
    return articles, sources, candidates


def saver(spark, folder):
    def save(name, df):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    return save


def test_run(spark, tmp_path):
    articles, sources, candidates = tables(spark)
    bodies = spark.createDataFrame([(1, "b")], "source_id long, guid string")
    said = []
    run = sync.Run(said.append)
    got = {r.guid: r for r in run.sync(articles, sources, candidates, saver(spark, tmp_path), bodies).collect()}
    # c is among the newest two of the source, d isn't; a is known; the disabled source is left alone
    assert set(got) == {"a", "b", "c", "z"} and got["a"].title == "new title" and got["b"].content_status == "ok"
    assert run.progress.new == 1 and run.progress.fetched == 1 and run.progress.failed == 1 and run.progress.done
    assert run.progress.message == "Finished with problems — no route" and said[-1] == run.progress
    only = sync.Run().sync(articles, sources, candidates, saver(spark, tmp_path / "b"), source_ids=[3])
    assert only.count() == 3


def test_run_is_cancelled(spark, tmp_path):
    articles, sources, candidates = tables(spark)
    run = sync.Run(lambda p: run.cancel())
    assert run.sync(articles, sources, candidates, saver(spark, tmp_path)).count() == 3
    assert run.progress.message == "Stopped"


def test_limits_of_options(spark):
    rows = [(1, '{"limit": 7}'), (2, None), (3, '{"limit": null}'), (4, '{"limit": "9"}'), (5, '{"limit": true}'), (6, "{}"), (7, "junk")]
    got = {r.source_id: r.n for r in sync.limits(spark.createDataFrame(rows, "source_id long, config string")).collect()}
    assert got == {1: 7, 2: None, 3: None, 4: None, 5: None, 6: None, 7: None}


def test_set_limit(spark):
    rows = spark.createDataFrame([('{"limit": 7, "x": "y"}',), (None,), ("junk",)], "config string")
    own = lambda n: [json.loads(r[0]) for r in rows.select(sync.with_limit(rows.config, n)).collect()]
    assert own(5) == [{"limit": 5, "x": "y"}, {"limit": 5}, {"limit": 5}] and own(None) == [{"x": "y"}, {}, {}]


def test_redetect(spark):
    sources = spark.createDataFrame([(1, "old", "h", '{"limit": 7, "path_prefix": "/b", "x": 1}', "ok", ""), (2, "old", "h", None, "ok", "")], "source_id long, plugin string, homepage string, config string, last_status string, last_message string")
    found = spark.createDataFrame([(1, "new", "h2", "feed", '{"feed": "f", "limit": 3}', None), (2, None, None, None, None, "gone")], "source_id long, plugin string, homepage string, detected string, config string, error string")
    got = {r.source_id: r for r in sync.redetect(sources, found).collect()}
    assert json.loads(got[1].config) == {"feed": "f", "limit": 7, "path_prefix": "/b", "detected": "feed (re-detected)"} and got[1].plugin == "new"
    assert got[2].plugin == "old" and got[2].last_status == "error" and got[2].last_message == "gone"


def test_platform_bodies():
    assert content.body_of("wordpress", f"<p>{WORDS}</p>", None, "https://e.com/")[1] == "api"
    page = f"<html><body><article><p>{WORDS}</p></article></body></html>"
    assert content.body_of("wordpress", "<p></p>", page, "https://e.com/") == content.body_of("generic", None, page, "https://e.com/")
    assert content.body_of("epub", "<p>x</p>", None, None) == ("<p>x</p>", "file")
    assert content.body_of("ghost", None, None, None) == ("", "direct")
    essay = f"""<html><head><title>Essays</title></head><body><map name=m></map><table><tr><td><font face="verdana">January 2005<br><br>First {WORDS}<br><br>
    <table><tr><td bgcolor="#ffffdd">Quoted words</td></tr></table><table><tr><td><b>Want to start a startup?</b> Get funded by Y Combinator.</td></tr></table>Last</font></td></tr></table></body></html>"""
    html, source = content.body_of("essay", None, essay, "https://e.com/x")
    assert source == "direct" and "January" not in html and "startup" not in html and "<blockquote>" in html and "Last" in html and "<p>First" in html
    assert content.essay_title(essay, "x") == "January 2005" and content.essay_title("", "slug") == "slug"


def test_keyed_reads(spark):
    sources = spark.createDataFrame([(1, "b", True), (2, "A", True), (3, "c", False)], "source_id long, source_name string, enabled boolean")
    assert [r.source_id for r in lookup.list_sources(sources).collect()] == [2, 1, 3] and lookup.list_sources(sources, True).count() == 2
    stored = spark.createDataFrame([("a", '{"x": 1}'), ("b", "[1]"), ("c", "{bad"), ("d", None)], "word string, payload string")
    assert [r.word for r in lookup.cached(stored).collect()] == ["a"]
    answers = spark.createDataFrame([("w", 404, None), ("w", 500, None), ("w", 200, "{}"), ("w", 200, "bad")], "word string, status int, payload string")
    got = [r[0] for r in answers.select(lookup.definition_entry(answers.word, answers.status, answers.payload)).collect()]
    assert json.loads(got[0]) == {"word": "w", "senses": [], "source": "Wiktionary"} and got[1] is None and json.loads(got[2])["senses"] == [] and got[3] is None
    flags = spark.createDataFrame([("/blog", "/blog/"), ("/blog", "/all"), ("", ""), (None, "/x")], "p string, i string")
    assert [r[0] for r in flags.select(merge.admits_members(flags.p, flags.i)).collect()] == [True, False, False, False]
