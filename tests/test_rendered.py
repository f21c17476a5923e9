"""Pages, sites and books rendered from the tables, against SQL; detection's edge cases by hand."""

import json
from datetime import date, datetime

import pytest

from inkstream.plans import archive, rendered
from inkstream.sources import detection, feeds
from inkstream.streaming import incremental, parts

OWN = [k for k, f in archive.QUERIES.items() if f.__module__ == rendered.__name__]


@pytest.mark.parametrize("name", OWN)
def test_twin(spark, twin, name):
    twin(archive.QUERIES[name](spark, "/root/testdata/sf0.001"), archive.ORACLES[name])


def _detect(spark, sites, pages, recipes=None):
    s = spark.createDataFrame(sites, "site long, url string")
    p = spark.createDataFrame(pages, "url string, status int, body string")
    return {r.site: r for r in detection.detect(s, p, recipes, date(2026, 1, 1)).collect()}


def test_detection_without_pages_or_addresses(spark):
    got = _detect(spark, [(1, "a.example"), (1, "a.example"), (2, None), (3, "  "), (4, "https://b.example/blog")], [])
    assert len(got) == 4 and got[2].error == got[3].error == "no address"
    assert (got[1].plugin, got[1].name, got[1].homepage, got[1].partial) == ("generic", "a.example", "https://a.example", True)
    assert json.loads(got[1].config) == {}  # nothing was fetched, so nothing is known to be absent
    assert json.loads(got[4].config) == {"strategy": "archive", "index": "/blog/"}
    assert not _detect(spark, [], [("https://a.example", 200, "x")])


def test_a_section_is_read_by_an_api_only_if_it_is_its_own(spark):
    api = "/wp-json/wp/v2/posts?per_page=1"
    pages = [("https://a.example/labs" + api, 200, "[]"), ("https://b.example/labs" + api, 200, "[]"), ("https://a.example/labs/wp-json/", 200, '{"home": "https://a.example/Labs/"}'), ("https://b.example/labs/wp-json/", 200, '{"home": "https://b.example"}')]
    got = _detect(spark, [(1, "https://a.example/labs/"), (2, "https://b.example/labs/")], pages)
    assert got[1].plugin == "wordpress" and json.loads(got[1].config) == {"api_root": "https://a.example/labs/wp-json/wp/v2"}
    assert got[2].plugin == "generic" and json.loads(got[2].config)["path_prefix"] == "/labs"


def test_a_missing_place_is_no_proof_of_absence(spark):
    gone = [("https://a.example" + p, 404, None) for p in detection.SITEMAP_PATHS]
    assert json.loads(_detect(spark, [(1, "https://a.example")], gone)[1].config) == {"sitemap": "", "hints_checked": "2026-01-01"}
    assert json.loads(_detect(spark, [(1, "https://a.example")], gone[1:] + [(gone[0][0], 500, None)])[1].config) == {}
    assert json.loads(_detect(spark, [(1, "https://a.example")], gone[1:])[1].config) == {}


def test_a_post_without_a_date_is_dated_by_its_address(spark):
    body = json.dumps([{"id": 1, "link": "https://a.example/2011/04/06/x/"}, {"id": 2, "link": "https://a.example/y/", "date_gmt": "2012-01-02T03:04:05"}])
    got = feeds.rest_posts(spark.createDataFrame([("s", 1, body)], "site string, page int, body string"), datetime(2026, 1, 1)).orderBy("pos").collect()
    assert [(r.date.iso, r.date.source) for r in got] == [(datetime(2011, 4, 6), "url:permalink"), (datetime(2012, 1, 2, 3, 4, 5), "wp:date_gmt")]


def test_a_run_taken_up_after_a_failure_gives_the_same_rows(spark, tmp_path, monkeypatch):
    kind = "source_id long, guid string, title string, published_at timestamp_ntz, date_confidence string"
    batch = lambda g, at: spark.createDataFrame([(1, g, g, at, "high", 0)], kind + ", pos long").coalesce(1)

    def run(name):
        top = f"{tmp_path}/{name}"
        return lambda: incremental.run_once(spark, f"{top}/in", batch("x", None).schema, f"{top}/snap", f"{top}/check")

    for name in ("whole", "broken"):
        parts.create(spark.createDataFrame([(1, "a", "A", datetime(2020, 1, 10), "high")], kind), f"{tmp_path}/{name}/snap")
        batch("new", datetime(2024, 1, 20)).write.mode("append").parquet(f"{tmp_path}/{name}/in")
        batch("near", datetime(2020, 1, 9)).write.mode("append").parquet(f"{tmp_path}/{name}/in")
    assert run("whole")() == 2
    real, calls = parts.upsert.upsert_articles, []

    def fails_second(*frames):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("an executor is gone")
        return real(*frames)

    monkeypatch.setattr(parts.upsert, "upsert_articles", fails_second)
    with pytest.raises(Exception, match="an executor is gone"):
        run("broken")()
    assert run("broken")() == 1  # the second batch only
    guids = lambda name: sorted(r.guid for r in parts.read(spark, f"{tmp_path}/{name}/snap", 2).collect())
    assert guids("broken") == guids("whole") == ["a", "near", "new"]
    assert not list((tmp_path / "broken" / "snap").glob("run-from-*"))
