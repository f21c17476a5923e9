"""Registered queries against their SQL twins, and the reading order's laws."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inkstream import fixtures, schemas
from inkstream.operators import merge, queue, schedule, scopes, sequence, stats, upsert
from inkstream.plans import archive, reading

SF = "/root/testdata/sf0.001"
NTZ = "timestamp_ntz"


@pytest.mark.parametrize("name", sorted(archive.ORACLES))
def test_sql_twin(spark, twin, name):
    twin(archive.QUERIES[name](spark, SF), archive.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(archive.QUERIES) - set(archive.ORACLES)))
def test_rows(spark, name):
    assert archive.QUERIES[name](spark, SF).count() > 0


def messy(spark):
    day = lambda y: datetime(y, 1, 1)
    rows = [(1, "c", day(2003), 0), (2, "a", day(2001), 0), (3, "t1", day(2002), 1), (4, "t2", day(2002), 2), (5, "t3", day(2002), 2), (6, "u1", None, 1), (7, "u2", None, 2)]
    return spark.createDataFrame([(i, 1, t, d, o) for i, t, d, o in rows], f"article_id long, source_id long, title string, published_at {NTZ}, source_order int")


@pytest.mark.parametrize(("newest", "want"), [(True, "c t3 t2 t1 a u1 u2"), (False, "a t1 t2 t3 c u1 u2")])
def test_messy_set(spark, newest, want):
    df = messy(spark)
    assert [r.title for r in df.orderBy(*sequence.order_keys(newest)).collect()] == want.split()
    assert [r.title for r in df.orderBy(*sequence.order_keys(newest, forward=False)).collect()] == want.split()[::-1]
    assert [r.title for r in sequence.ranked(df, newest).orderBy("rank").collect()] == want.split()


@pytest.mark.parametrize("newest", [True, False])
def test_neighbours_walk_the_queue(spark, newest):
    df = messy(spark).cache()
    rows = df.orderBy(*sequence.order_keys(newest)).collect()
    for k, r in enumerate(rows):
        anchor = r.asDict()
        nxt, prv = sequence.neighbour(df, anchor, newest).collect(), sequence.neighbour(df, anchor, newest, forward=False).collect()
        assert [x.article_id for x in nxt] == [x.article_id for x in rows[k + 1 : k + 2]]
        assert [x.article_id for x in prv] == [x.article_id for x in rows[max(0, k - 1) : k]]
        assert sequence.position(df, anchor, newest).first() == (k + 1, len(rows))


def test_search(spark):
    df = spark.createDataFrame([(1, "Café Noir", "the end"), (2, "Tea", None), (3, "the-café", "")], "article_id long, title string, excerpt string")
    found = lambda q: [r.article_id for r in df.where(scopes.search(q, "title", "excerpt")).collect()]
    assert found("") == [1, 2, 3] and found("--!") == [] and found("caf") == [1, 3] and found("CAFÉ the") == [1, 3] and found("noir en") == [1] and found("afe") == []
    index = scopes.word_index(df, "title", "excerpt")
    assert sorted(r.article_id for r in scopes.search_index(index, "caf the").collect()) == [1, 3]


def test_any_known_date_replaces_unknown_never_does(spark):
    cur = spark.createDataFrame([(1, "g", "u", "Old", None, 3, datetime(2000, 1, 1), "day", "exact", "feed", "body")], f"source_id long, guid string, url string, title string, author string, source_order int, published_at {NTZ}, date_precision string, date_confidence string, date_source string, body string")
    new = cur.limit(0).drop("body").unionByName(spark.createDataFrame([(1, "g", None, "", "A", None, datetime(2001, 1, 1), "year", "inferred", "x"), (1, "h", "v", "New", None, 1, None, "unknown", "unknown", "")], cur.drop("body").schema))
    got = {r.guid: r for r in upsert.upsert_articles(cur, new).collect()}
    assert (got["g"].title, got["g"].url, got["g"].author, got["g"].date_confidence, got["g"].body) == ("Old", "u", "A", "inferred", "body")
    assert got["h"].title == "New" and got["h"].published_at is None
    later = upsert.upsert_articles(cur, new.where("guid = 'g'").withColumn("published_at", F.lit(None).cast(NTZ))).first()
    assert later.published_at == datetime(2000, 1, 1) and later.date_confidence == "exact"


NOW = datetime(2026, 9, 5, 12)


@pytest.mark.parametrize(("every", "since", "silent", "posts", "due"), [(1, 8, 0, 12, True), (30, 8, 0, 12, False), (1, 0, 0, 12, False), (300, 73, 0, 12, True), (7, 6, 900, 12, False), (5, 2, 0, 2, True)])
def test_due(spark, every, since, silent, posts, due):
    from datetime import timedelta

    rows = [(k, 1, NOW - timedelta(days=silent + k * every)) for k in range(posts)]
    df = spark.createDataFrame(rows, f"article_id long, source_id long, published_at {NTZ}")
    src = spark.createDataFrame([(1, NOW - timedelta(hours=since))], f"source_id long, last_sync_at {NTZ}")
    assert schedule.due(src, df, NOW).first().due is due


def test_merge_keeps_the_first_of_equal_confidence(spark):
    rows = [("g", "a", "feed", 0, "F", datetime(2003, 1, 1), "high"), ("g", "b", "archive", 9, "", datetime(2001, 1, 1), "high"), ("g", "c", "sitemap", 0, None, None, "unknown"), ("k", "d", "feed", 0, None, None, "unknown")]
    df = spark.createDataFrame(rows, f"guid string, url string, route string, pos long, title string, published_at {NTZ}, date_confidence string")
    got = {r.guid: r for r in merge.merge(df).collect()}
    assert (got["g"].url, got["g"].published_at, got["g"].title, got["g"].evidence) == ("b", datetime(2001, 1, 1), "F", ["archive", "feed", "sitemap"])
    assert got["k"].published_at is None


def test_migration(spark):
    old = spark.createDataFrame([(7, datetime(2020, 1, 1), 0.5)], f"article_id long, read_at {NTZ}, scroll_pos double")
    new = schemas.migrate(old, schemas.READING_STATE)
    assert new.columns == schemas.READING_STATE.names and new.first().skipped_at is None and new.first().scroll_pos == 0.5


def test_notes_highlights_and_cascade(spark):
    notes = spark.createDataFrame([(1, "x", datetime(2020, 1, 1)), (2, "y", datetime(2020, 1, 1))], schemas.NOTES)
    changes = spark.createDataFrame([(1, "  ", datetime(2021, 1, 1)), (3, "z", datetime(2021, 1, 1))], schemas.NOTES)
    assert sorted((r.article_id, r.body) for r in upsert.set_notes(notes, changes).collect()) == [(2, "y"), (3, "z")]
    marks = spark.createDataFrame([(1, 1, "q", None, None, None, 5, None, None), (2, 1, "q", None, None, None, 5, None, datetime(2020, 1, 1))], schemas.HIGHLIGHTS)
    found = spark.createDataFrame([(1, None), (2, 9)], "highlight_id long, offset int")
    got = {r.highlight_id: r for r in upsert.reanchor(marks, found, F.lit(datetime(2022, 1, 1)).cast(NTZ)).collect()}
    assert got[1].orphaned_at == datetime(2022, 1, 1) and got[2].orphaned_at is None and got[2].start_offset == 9
    arts = spark.createDataFrame([(1, 1), (2, 2)], "article_id long, source_id long")
    out = upsert.cascade(1, spark.createDataFrame([(1,), (2,)], "source_id long"), arts, notes=notes)
    assert [r.article_id for r in out["notes"].collect()] == [2] and out["sources"].count() == 1


def test_queue_reads_only_what_it_needs(spark):
    df = archive.archive(spark, SF).where(scopes.scope_filter()).select("article_id", "published_at")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "benchmark" not in plan or "text" in plan
    top = queue.queue(archive.archive(spark, SF), limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


def test_views_and_stats_on_empty_tables(spark):
    a = fixtures.view(spark, SF, "fx_articles").limit(0)
    assert stats.skip_rates(a, fixtures.view(spark, SF, "fx_reading_state")).count() == 0
    assert stats.library(a, fixtures.view(spark, SF, "fx_images").limit(0)).first().bytes == 0


def test_command_line(spark, tmp_path):
    from inkstream import cli

    for name in ("articles", "sources", "reading_state", "highlights", "notes", "images"):
        fixtures.view(spark, SF, f"fx_{name}").write.parquet(f"{tmp_path}/a/{name}")
    at = ["--data", f"{tmp_path}/a"]
    assert cli.run(spark, [*at, "queue", "--limit", "7"]).count() == 7
    assert cli.run(spark, [*at, "sources"]).count() == 20 and cli.run(spark, [*at, "stats"]).count() == 20
    assert cli.run(spark, [*at, "export", "--to", f"{tmp_path}/x", "--limit", "all"]).count() > 50
    cli.run(spark, [*at, "remove", "3", "--to", f"{tmp_path}/b"])
    assert spark.read.parquet(f"{tmp_path}/b/articles").where("source_id = 3").count() == 0
    assert cli.run(spark, [*at, "rename", "4", "Four", "--to", f"{tmp_path}/c"]).where("source_name = 'Four'").count() == 1
    add = [*at, "add", "--homepage", "https://www.new.example/x", "--name", "New", "--plugin", "generic", "--detected", "feed", "--limit", "9", "--to", f"{tmp_path}/d"]
    new = cli.run(spark, add).where("slug = 'new-example'").first()
    assert new.source_id == 20 and new.enabled and '"limit": 9' in new.config
    at = ["--data", f"{tmp_path}/d"]
    got = cli.run(spark, [*at, "set-limit", "20", "--limit", "all", "--to", f"{tmp_path}/e"]).where("source_id = 20").first()
    assert "limit" not in got.config and "detected" in got.config
    cli.run(spark, [*at, "prune", "--to", f"{tmp_path}/f"])
    assert spark.read.parquet(f"{tmp_path}/f/images").count() == 0
    late = spark.createDataFrame([(20, "g", "Late")], "source_id long, guid string, title string")
    late.selectExpr("*", "timestamp_ntz'2024-02-02 00:00:00' AS published_at", "0 AS source_order").write.parquet(f"{tmp_path}/late")
    cli.run(spark, [*at, "sync", "--candidates", f"{tmp_path}/late", "--to", f"{tmp_path}/g"])
    assert spark.read.parquet(f"{tmp_path}/g/articles").where("guid = 'g'").first().title == "Late"
    assert spark.read.parquet(f"{tmp_path}/g/sources").count() == 21


def test_command_line_adds_books(spark, tmp_path):
    from inkstream import cli

    from .test_functions import book

    (tmp_path / "b.epub").write_bytes(book())
    sources = spark.createDataFrame([(4, "S")], "source_id long, source_name string").withColumn("enabled", F.lit(True))
    one = cli.add_book(spark, cli.migrate_columns(sources), str(tmp_path / "b.epub"), None)
    row = one.where("source_id = 5").first()
    assert row.plugin == "epub" and row.slug.startswith("book-") and "chapters" in row.config
    assert cli.add_book(spark, one, str(tmp_path / "b.epub"), None).count() == 2
    (tmp_path / "bad.epub").write_bytes(b"no book")
    with pytest.raises(SystemExit):
        cli.add_book(spark, one, str(tmp_path / "bad.epub"), None)


def test_images_wanted(spark):
    a = spark.createDataFrame([(1, '<img src="a"><img src="b">'), (2, "<img src='a'>"), (3, None)], "article_id long, content_html string")
    got = upsert.images_wanted(a, spark.createDataFrame([("b",)], "url string")).collect()
    assert [(r.article_id, r.url) for r in got] == [(1, "a")]


def test_ranks_and_headers_need_no_single_task(spark, monkeypatch):
    rows = archive.archive(spark, SF)
    assert "NestedLoop" not in rows._jdf.queryExecution().executedPlan().toString()
    hot = spark.range(300).selectExpr("id AS article_id", "1L AS source_id", "CAST(id % 3 AS INT) AS source_order", "IF(id % 2 = 0, timestamp_ntz'2020-01-01 00:00:00', NULL) AS published_at")
    for newest in (False, True):
        want = [r.article_id for r in hot.orderBy(*sequence.order_keys(newest)).collect()]
        got = sequence.ranked(hot, newest, parts=7).collect()
        assert [r.article_id for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 301))
    # As many ranges as the rows ask for; each is a task, and the labels at their borders are those of one range.
    monkeypatch.setattr(sequence, "RANGE_ROWS", 50)
    rows, ranges = sequence._in_ranges(hot, False, None)
    assert ranges == 6 and 1 < rows.groupBy(sequence._range().alias("r")).count().count() <= 6
    labels = hot.withColumn("label", F.concat(F.coalesce(F.date_format("published_at", "yyyy"), F.lit("none")), "source_order"))
    before = lambda parts: sorted((r.article_id, r.before or "") for r in sequence.labelled_before(labels, "label", parts=parts).collect())
    assert before(None) == before(1) and sum(not b for _, b in before(None)) == 1
    assert sequence.ranked(hot.limit(0)).count() == 0


def test_headings_keep_a_reference_that_is_cut_short(spark, twin, tmp_path):
    pages = ["<h1>A &amp;&amp; B&amp</h1><h1>C</h1>", "<title>x</title>", "<h1> a  <b>b</b>&quot;\n</h1>".replace("\n", " "), "<h1>AT&ampT &copy &amp;amp; &nosuch; &</h1>", None]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("https://s.example/")).toPandas().to_parquet(tmp_path / "sf/pages.parquet")
    got = archive.QUERIES["page_titles"](spark, str(tmp_path / "sf"))
    assert [r.title for r in got.orderBy("page_id").collect()] == ["A && B&amp", "", 'a b"', "AT&ampT &copy &amp; &nosuch; &", None]
    twin(archive.QUERIES["page_titles"](spark, "/root/testdata/sf0.1"), archive.ORACLES["page_titles"], "/root/testdata/sf0.1")  # eight of its headings end in a bare reference
