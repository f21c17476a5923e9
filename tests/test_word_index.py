"""The kept index against a search through the texts."""

import random
from pathlib import Path

import pyarrow.parquet as pq

import __spark_entry__ as entry
from inkstream.operators import scopes
from inkstream.streaming import word_index

COLUMNS = "article_id long, title string, excerpt string"
QUERIES = ["b", "ba", "bab", "b a", "a ab aba", "É", "b, b", "zzz", "!?", "ab12"]


def _text(draw):
    return draw.choice([None, "", " ".join("".join(draw.choice("abé1") for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(1, 6)))])


def test_changed_and_deleted_articles_are_found_as_they_are_now(spark, tmp_path):
    draw, path, now = random.Random(4), f"{tmp_path}/i", {}
    assert word_index.search(spark, path, "a").count() == 0 and word_index.compact(spark, path) is None
    for number in range(4):
        new = {k: (k, _text(draw), _text(draw)) for k in draw.sample(range(60), 40 if number == 0 else 12)}
        gone = [k for k in draw.sample(sorted(now), min(5, len(now))) if k not in new]
        now = {k: v for k, v in now.items() if k not in gone} | new
        batch = spark.createDataFrame([*new.values(), (None, "bab", "a")], COLUMNS).repartition(3)
        for _ in range(2 if number == 2 else 1):  # run again after a failure
            word_index.add(batch, path, number, "title", "excerpt", deleted=spark.createDataFrame([(k,) for k in gone], "article_id long"), files=3)
        if number == 1:
            assert word_index.compact(spark, path, files=3) == 1 == word_index.compact(spark, path)
        own = spark.createDataFrame(list(now.values()), COLUMNS).cache()
        hits = 0
        for q in QUERIES if number in (1, 3) else QUERIES[:2]:
            want = sorted(r.article_id for r in own.where(scopes.search(q, "title", "excerpt")).collect())
            assert sorted(r.article_id for r in word_index.search(spark, path, q).collect()) == want
            hits += len(want)
        assert hits > 10 and word_index.matching(own, path, "").count() == len(now)
        own.unpersist()


def test_a_prefix_reads_a_range_of_files(spark, tmp_path):
    """Files are ranges of words, a word that all have is in several, and the prefix is pushed to the scan."""
    rows = spark.range(3000).selectExpr("id AS article_id", "'common' AS title", "concat(char(97 + id % 26), 'x', id) AS excerpt")
    word_index.add(rows, f"{tmp_path}/i", 0, "title", "excerpt", files=8)
    ranges = []
    for f in sorted(Path(f"{tmp_path}/i/words-0").glob("part-*.parquet")):
        words = pq.read_table(f, columns=["token"])["token"].to_pylist()
        assert words == sorted(words)
        ranges.append((words[0], words[-1]))
    ranges.sort()
    assert len(ranges) == 8 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert sum(a <= "common" <= b for a, b in ranges) >= 3
    found = word_index.search(spark, f"{tmp_path}/i", "zx")
    assert found.count() == 115 and "StringStartsWith(token,zx)" in found._jdf.queryExecution().executedPlan().toString()
    assert sum(a < "zy" and b >= "zx" for a, b in ranges) == 1


def test_query_agrees_with_sql(spark, twin):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        twin(entry.queries()["queue_search_index"](spark, sf), entry.oracle_sql()["queue_search_index"], sf)
    assert entry.oracle_sql()["queue_search_index"] == entry.oracle_sql()["queue_search_prefix"]
