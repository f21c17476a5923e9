"""All quotes of an article at once against one quote at a time."""

import random

import __spark_entry__ as entry
from inkstream.functions import anchors
from inkstream.operators import upsert

MARKS = "highlight_id long, article_id long, quote string, prefix string, suffix string, start_offset int"


def _case(seed, quotes):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice(["a", "b", "ab", " ", "  ", "\n", "é", "🙂", "文"]) for _ in range(n))
    bodies = [(k, text(draw.choice([0, 5, 300]))) for k in range(1, 6)] + [(6, None), (7, "a" * 1500)]
    marks = []
    for h in range(quotes):
        k, body = bodies[0 if h % 3 == 0 else draw.randrange(len(bodies))]  # the first has a third of all quotes
        at = draw.randrange(max(1, len(body or "")))
        quote = draw.choice([(body or "")[at : at + draw.randint(1, 6)], "a", "aa", "", "   ", None, "nowhere"])
        marks.append((h, k, quote, draw.choice(["", None, (body or "")[max(0, at - 4) : at]]), draw.choice(["", "b", None]), draw.choice([at, 0, None])))
    return bodies, marks


def test_quotes_together_stand_where_each_stands_alone(spark):
    bodies, marks = _case(5, 400)
    texts = dict(bodies)
    want = {h: anchors.locate(texts[k], q or "", p or "", s or "", o or 0) for h, k, q, p, s, o in marks}
    assert sum(x is not None for x in want.values()) > 60
    m, a = spark.createDataFrame(marks, MARKS).repartition(3), spark.createDataFrame(bodies, "article_id long, body string").selectExpr("article_id", "body", "'x' AS at", "1 AS pass")
    for size in (7, 1000):
        got = {r.highlight_id: r["at"] for r in anchors.located_in(m, a, size).collect()}
        assert got == want


def test_overlaps_and_the_first_201_places():
    assert anchors.locate_many("aaaa", [("a", "", "", 9), ("aa", "", "", 9), ("aaa", "", "", 9), ("aaaaa", "", "", 0)]) == [3, 2, 1, None]
    assert anchors.locate_many("a" * 1000, [("a", "", "", 999)]) == [200] == [anchors.locate("a" * 1000, "a", hint=999)]
    assert anchors.locate_many("one  two", [("one two", None, None, None)]) == [0] and anchors.locate_many("x", []) == []


def test_texts_are_moved_once_a_pass(spark):
    marks = spark.range(500).selectExpr("id AS highlight_id", "id % 2 AS article_id", "string(id) AS quote", "'' AS prefix", "'' AS suffix", "0 AS start_offset")
    marks = marks.where("article_id = 1 OR highlight_id = 0")
    assert sorted((r.article_id, r["count"]) for r in anchors.by_text(marks, 100).groupBy("article_id").count().collect()) == [(0, 1), (1, 3)]
    assert anchors.by_text(marks).count() == 2


def test_marks_follow_a_changed_text(spark):
    """A quote that moved has its new place, one that went is kept and marked as lost, once."""
    from pyspark.sql import functions as F

    marks = spark.createDataFrame([(1, 1, "old words", "", "", 0), (2, 1, "gone", "", "", 3), (3, 9, "no article", "", "", 4)], MARKS).withColumn("orphaned_at", F.lit(None).cast("timestamp_ntz"))
    found = anchors.located_in(marks, spark.createDataFrame([(1, "New. old  words")], "article_id long, body string")).withColumnRenamed("at", "offset")
    got = {r.highlight_id: (r.start_offset, r.orphaned_at is None) for r in upsert.reanchor(marks, found, F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    assert got == {1: (5, True), 2: (3, False), 3: (4, True)}


def test_query_agrees_with_sql(spark, twin):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        twin(entry.queries()["locate_with_context"](spark, sf), entry.oracle_sql()["locate_with_context"], sf)
