"""Streams with state over batches and restarts, and an archive in parts."""

import json
import os
from datetime import datetime, timedelta

import pytest
from inkstream.operators import upsert
from inkstream.streaming import incremental, pages, parts, stateful
from pyspark.sql import functions as F

POSTS = "source_id long, guid string, published_at timestamp_ntz, pos long"
ARTICLES = "source_id long, guid string, title string, published_at timestamp_ntz, date_confidence string"
DAY = datetime(2024, 1, 1)


def runs(spark, top, build, schema=POSTS):
    """put(rows) adds a file; run(*args) starts the stream again from its checkpoint and gives all that came out."""
    progress = []

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{top}/in")

    def run(*args):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
        query = build(stream, *args).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        progress.append(query.lastProgress)
        return sorted(r.guid or "" for r in spark.read.parquet(f"{top}/out").collect())

    return put, run, progress


def test_a_post_comes_out_once_over_batches_and_restarts(spark, tmp_path):
    stateful.keep_state(spark)
    put, run, progress = runs(spark, tmp_path, lambda s: stateful.once(s, "at", "2 days"), "source_id long, guid string, at timestamp_ntz, route string")
    put([(1, "a", DAY, "feed"), (1, "a", DAY, "sitemap"), (2, "a", DAY, "feed"), (None, None, DAY, "feed")])
    put([(1, "a", DAY + timedelta(hours=5), "archive"), (1, "b", DAY, "feed"), (None, None, DAY, "x")])
    assert run() == ["", "a", "a", "b"]
    put([(1, "b", DAY + timedelta(days=1), "feed"), (1, "c", DAY + timedelta(days=1), "feed")])
    assert run() == ["", "a", "a", "b", "c"]
    # Once the watermark has passed by, the state is gone: it stays as small as the delay, not as the stream.
    for k in range(2, 8):
        put([(1, f"d{k}", DAY + timedelta(days=3 * k), "feed")])
    assert len(run()) == 11
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_undated_posts_are_counted_over_the_batches_of_a_run(spark, tmp_path):
    known = spark.createDataFrame([(1, "k"), (1, "k")], "source_id long, guid string")
    floor = spark.createDataFrame([(1, DAY)], "source_id long, floor timestamp_ntz")
    limits = spark.createDataFrame([(1, 2), (None, 1)], "source_id long, n long")
    put, run, _ = runs(spark, tmp_path, lambda s, number: stateful.admitted(s, known, floor, limits, number))
    put([(1, "k", None, 0), (1, "a", None, 2), (1, "old", DAY - timedelta(1), 3), (1, "new", DAY, 4), (None, "n2", None, 9), (None, "n1", None, 1)])
    put([(1, "b", None, 6), (1, "c", None, 5), (2, "no limit", None, 7), (2, "free", DAY, 8)])
    first = ["a", "c", "free", "k", "n1", "new"]
    assert run(1) == first
    # The same run, taken up again: its two are used up.
    put([(1, "d", None, 1)])
    assert run(1) == first
    put([(1, "e", None, 3), (1, "f", None, 2), (1, "g", None, 1), (None, "n3", None, None)])
    assert run(2) == sorted([*first, "f", "g", "n3"])


def test_without_limits_all_undated_posts_pass(spark, tmp_path):
    none = spark.createDataFrame([], "source_id long, guid string"), spark.createDataFrame([], "source_id long, floor timestamp_ntz")
    put, run, _ = runs(spark, tmp_path, lambda s: stateful.admitted(s, *none, None, 0))
    put([(1, "a", None, 0), (None, None, None, 1)])
    assert run() == ["", "a"]


def articles(spark, rows):
    return spark.createDataFrame([(s, g, t, None, "unknown") for s, g, t in rows], ARTICLES)


def files(top):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_ino for d, _, names in os.walk(top) for f in names if f.startswith("part-")}


def rows_of(df):
    return sorted((r.source_id or 0, r.guid or "", r.title or "") for r in df.collect())


def test_a_batch_rewrites_only_the_parts_it_touches(spark, tmp_path):
    top = f"{tmp_path}/archive"
    old = articles(spark, [(k % 3, f"g{k}", "old") for k in range(300)])
    parts.create(old, top, 32)
    before = files(f"{top}/data")
    assert len(before) == 32 and rows_of(parts.read(spark, top, 0)) == rows_of(old)
    batch = articles(spark, [(0, "g0", "new"), (9, "h", "new"), (None, None, "x")])
    touched = parts.merge(spark, top, batch, 0)
    added = files(f"{top}/data").keys() - before.keys()
    assert len(added) == len(touched) <= 3 and parts.last(spark, top) == 1
    want = rows_of(upsert.upsert_articles(old, batch))
    assert rows_of(parts.read(spark, top, 1)) == want
    # The state before is still there; the same batch again leaves other parts alone and gives the same rows.
    assert rows_of(parts.read(spark, top, 0)) == rows_of(old)
    kept = {f: i for f, i in files(f"{top}/data").items() if f not in added}
    assert parts.merge(spark, top, batch, 0) == touched and rows_of(parts.read(spark, top, 1)) == want
    assert {f: files(f"{top}/data").get(f) for f in kept} == kept and len(files(f"{top}/data")) == len(before) + len(touched)
    # A batch of nothing is a state of its own.
    assert parts.merge(spark, top, batch.limit(0), 1) == set() and rows_of(parts.read(spark, top, 2)) == want
    assert parts.vacuum(spark, top, 1) == len(touched & {int(f.split("part=")[1].split("/")[0]) for f in before})
    assert rows_of(parts.read(spark, top, parts.last(spark, top))) == want


def test_an_archive_of_nothing(spark, tmp_path):
    parts.create(articles(spark, []), f"{tmp_path}/a", 4)
    assert parts.read(spark, f"{tmp_path}/a", 0).count() == 0
    parts.merge(spark, f"{tmp_path}/a", articles(spark, [(1, "g", "t")]), 0)
    assert rows_of(parts.read(spark, f"{tmp_path}/a", 1)) == [(1, "g", "t")]


def test_a_run_with_limits_that_fails_between_writing_and_counting(spark, tmp_path, monkeypatch):
    batch = lambda *rows: spark.createDataFrame([(1, g, g, None, "unknown", k) for g, k in rows], ARTICLES + ", pos long").coalesce(1)
    limits = spark.createDataFrame([(1, 3)], "source_id long, n long")
    parts.create(articles(spark, [(1, "a", "A")]), f"{tmp_path}/archive", 8)
    for rows in ([("b", 0), ("c", 1)], [("d", 2), ("e", 3)], [("f", 4)]):
        batch(*rows).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: incremental.run_once(spark, f"{tmp_path}/in", batch(("x", 0)).schema, f"{tmp_path}/archive", f"{tmp_path}/check", limits)
    real, calls = parts._commit, []

    def fails_second(*how):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("the driver is gone")
        return real(*how)

    monkeypatch.setattr(parts, "_commit", fails_second)
    with pytest.raises(Exception, match="the driver is gone"):
        run()
    assert parts.last(spark, f"{tmp_path}/archive") == 1
    run()
    assert [g for _, g, _ in rows_of(parts.read(spark, f"{tmp_path}/archive", parts.last(spark, f"{tmp_path}/archive")))] == ["a", "b", "c", "d"]


def test_the_queries_of_streams(spark, twin):
    from inkstream.plans import archive, rendered  # noqa: F401

    for name in ("arrivals_once", "undated_allowance", "incremental_runs", "pages_until_old"):
        twin(archive.QUERIES[name](spark, "/root/testdata/sf0.001"), archive.ORACLES[name])


def site(top, name, pages):
    os.makedirs(top / name, exist_ok=True)
    for k, rows in enumerate(pages, 1):
        (top / name / f"page-{k}.json").write_text(json.dumps([{"link": u, "date": at and at.isoformat()} for u, at in rows]))
    return str(top / name)


def asked(top, run):
    return {(f.parent.name.split("%2F")[-1], int(f.name[5:])) for f in (top / "notes" / f"run-{run}").glob("*/page-*")}


def test_a_source_stops_asking_after_a_page_of_nothing_new(spark, tmp_path):
    old, new = DAY - timedelta(days=9), DAY + timedelta(days=9)
    sites = [
        site(tmp_path, "a", [[("a1", new), ("a2", new)], [("a3", old), ("a4", new)], [("a5", old), ("a6", old)], [("a7", old)], [("a8", old)]]),  # page 3 is wholly old
        site(tmp_path, "b", [[("b1", None)], [("b2", None), ("b3", None)], [("b4", None)], [("b5", None)]]),  # page 2 is known
        site(tmp_path, "c", [[("c1", new)], [("c2", new)]]),  # ends by itself: page 3 is empty
        site(tmp_path, "d", []),
    ]
    spark.createDataFrame([(sites[1], "b2"), (sites[1], "b3"), (sites[2], "b1")], "site string, url string").coalesce(1).write.parquet(f"{tmp_path}/known")
    how = {"path": ",".join(sites), "notes": f"{tmp_path}/notes", "known": f"{tmp_path}/known", "floors": json.dumps({sites[0]: DAY.isoformat()})}
    run = lambda n: pages.read_run(spark, f"{tmp_path}/out", f"{tmp_path}/check", **how, run=str(n))
    first = ["a1", "a2", "a3", "a4", "a5", "a6", "b1", "b2", "b3", "c1", "c2"]
    assert sorted(r.url for r in run(1).collect()) == first
    wanted = {("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("c", 3), ("d", 1)}
    assert asked(tmp_path, 1) == wanted
    # Started again, the same run asks for nothing more.
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "notes").rglob("page-*")}
    assert sorted(r.url for r in run(1).collect()) == first and {f: f.stat().st_mtime_ns for f in (tmp_path / "notes").rglob("page-*")} == before
    # A later run begins at the first pages, and stops as soon as they bring nothing new.
    how["floors"] = json.dumps(dict.fromkeys(sites, (new + timedelta(days=1)).isoformat()))
    assert len(run(2).collect()) == len(first) + 6 and asked(tmp_path, 2) == {("a", 1), ("b", 1), ("b", 2), ("c", 1), ("d", 1)}


def test_a_run_that_was_stopped_goes_on_from_its_notes(spark, tmp_path):
    top = site(tmp_path, "s", [[(f"p{k}", None)] for k in range(4)])
    how = {"path": top, "notes": f"{tmp_path}/notes"}
    reader = pages.PageReader(how)
    assert reader.latestOffset() == {"run": 0, "pages": {top: 1}}
    list(reader.read(pages.Page(top, 1)))
    offset = reader.latestOffset()
    assert offset["pages"] == {top: 2} and [p.number for p in reader.partitions(reader.initialOffset(), offset)] == [1, 2]
    assert [p.number for p in reader.partitions({"run": 0, "pages": {top: 1}}, offset)] == [2]
    assert [p.number for p in reader.partitions({"run": 7, "pages": {top: 9}}, offset)] == [1, 2]
    assert sorted(r.url for r in pages.read_run(spark, f"{tmp_path}/out", f"{tmp_path}/check", **how).collect()) == ["p0", "p1", "p2", "p3"]


def test_pages_are_written_as_blocks_and_known_links_are_looked_up(spark, tmp_path):
    listed = spark.range(2 * pages.BLOCK * 3 + 1).selectExpr("id % 2 AS site", "CAST(id div 6 + 1 AS INT) AS page", "CAST(id AS STRING) AS link", "'2024-01-01T00:00:00' AS date", "'' AS title")
    pages.write_pages(listed, f"{tmp_path}/sites")
    assert len(list((tmp_path / "sites").rglob("*.parquet"))) == 3  # as many as blocks, not as pages
    source = pages.ParquetPages({"path": f"file://{tmp_path}/sites/site=0"})
    last = pages.BLOCK + 1
    got = {n: [r["link"] for r in source.page(n)] for n in (1, 2, pages.BLOCK, last, last + 1, 9 * pages.BLOCK)}
    assert got == {1: ["0", "2", "4"], 2: ["6", "8", "10"], pages.BLOCK: ["5994", "5996", "5998"], last: ["6000"], last + 1: [], 9 * pages.BLOCK: []}
    spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], "site string, url string").write.parquet(f"{tmp_path}/known")
    reader = pages.PageReader({"path": "a,b", "notes": f"{tmp_path}/notes", "known": f"{tmp_path}/known"})
    assert reader._known("a", ["x", "y", "q"]) == {"x"} and reader._known("a", []) == set()
