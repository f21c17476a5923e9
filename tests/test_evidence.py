"""Evidence merged in parts against evidence merged at once."""

import random
from datetime import datetime

import __spark_entry__ as entry
from inkstream.operators import merge
from inkstream.streaming import evidence

COLUMNS = "guid string, url string, route string, pos long, title string, html string, published_at timestamp_ntz, date_confidence string, date_precision string, foreign boolean"


def _rows(n):
    draw, pick = random.Random(8), lambda *x: random.choice(x)
    random.seed(8)
    out = []
    for _ in range(n):
        at = pick(None, datetime(2020, 1, draw.randint(1, 3)))
        guid = "hot" if draw.random() < 0.3 else f"g{draw.randint(0, 25)}"
        # Few places, so that many rows share route and place.
        out.append((guid, pick("u", "v", None), pick("archive", "sitemap", "feed", None), pick(1, 2, None), pick("", " ", None, "T", "S"), pick(None, "<p>"), at, pick("exact", "medium", "unknown", None), pick("day", None), pick(True, False, None)))
    return out


def _plain(df):
    return sorted(map(str, (r.asDict(recursive=True) for r in df.collect())))


def test_parts_in_any_order_give_what_all_rows_give(spark, tmp_path):
    rows = _rows(400)
    df = spark.createDataFrame(rows, COLUMNS)
    want = _plain(merge.merge(df.repartition(5)))
    assert len(want) == 27
    for name, cuts in (("two", [(200, 400), (0, 200)]), ("three", [(300, 400), (0, 120), (120, 300)])):
        path = f"{tmp_path}/{name}"
        assert evidence.compact(spark, path) is None and evidence.read(spark, path).count() == 0
        for number, (a, b) in enumerate(cuts):
            part = spark.createDataFrame(rows[a:b], COLUMNS)
            evidence.add(part, path, number)
            evidence.add(part, path, number)  # run again after a failure
            if number == 1:
                before = _plain(merge.merged(evidence.read(spark, path)))
                assert evidence.compact(spark, path) == 1 == evidence.compact(spark, path)
                assert _plain(merge.merged(evidence.read(spark, path))) == before
        evidence.add(spark.createDataFrame(rows[:50], COLUMNS), path, 9)  # rows that are known already
        assert _plain(merge.merged(evidence.read(spark, path))) == want
        assert evidence.read(spark, path, upto=0).count() <= 27


def test_a_batch_that_was_not_written_whole_is_not_read(spark, tmp_path):
    path = f"{tmp_path}/e"
    evidence.add(spark.createDataFrame(_rows(5), COLUMNS), path, 0)
    n = evidence.read(spark, path).count()
    (tmp_path / "e" / "batch-1").mkdir()
    assert evidence.read(spark, path).count() == n


def test_queries_agree_with_sql(spark, twin):
    for name in ("evidence_merge", "evidence_in_batches"):
        twin(entry.queries()[name](spark, "/root/testdata/sf0.01"), entry.oracle_sql()[name], "/root/testdata/sf0.01")
