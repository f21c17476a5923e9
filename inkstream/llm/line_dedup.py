"""Repeated runs of lines across documents, by winnowing over line hashes.

DataFrame functions only.  At every line that has room for it a window begins: the run of whole lines, as short as
possible, with at least ``min_words`` words in all.  Winnowing keeps of each window the smallest line hash (the first
of equals) as its fingerprint, so any two equal runs of that many words have a fingerprint at the same place in common,
and neighbouring windows mostly share theirs.  Fingerprints are counted over all documents; only around those that
stand at two places or more are the texts looked at again: positions are joined to these fingerprints, a match is
extended to the left up to where a window of the position begins and to the right to its end, then line by line
beyond it while fewer than ``min_words`` words follow (more words would begin a window of their own), and matches with
equal lines are compared by 128 bits.  The first of equal runs, by document id and line, stays; the lines of later ones
are deleted, and touching deletions are one run.

A line is compared without outer spaces; its words are what single spaces part, so an empty line counts as one.
Null texts are empty (one empty line).  Rows that share id and text are one document and get the same deletions.  A
null id sorts first.  Empty tables: no rows.

Common lines are counted on the map side and never paired; every run meets its first occurrence only.  Runs that are
compared hold fewer than twice ``min_words`` lines.  Hashes of lines are 64 bits wide, those of runs 128.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise, maybe_broadcast

MIN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, key, pos, h, begin, end (in words) of every line; print and place (its line) of the window that begins there, if one does."""
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    line = lambda x: F.struct(F.xxhash64(F.trim(x)).alias("h"), words(F.trim(x)).cast("long").alias("w"))
    docs = docs.select("doc_id", _text_key(F.col("text")).alias("key"), F.transform(_lines(F.col("text")), line).alias("lines"))
    docs = docs.groupBy("doc_id", "key").agg(F.first("lines").alias("lines"))
    lines = docs.select("doc_id", "key", F.posexplode("lines").alias("pos", "line")).select("doc_id", "key", "pos", "line.h", "line.w")
    so_far = Window.partitionBy("doc_id", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("end", F.sum("w").over(so_far)).withColumn("begin", F.col("end") - F.col("w")).drop("w")
    ahead = _ahead(min_words)
    lines = lines.withColumn("least", F.min(F.struct("h", "pos")).over(ahead)).withColumn("room", F.max("end").over(ahead) - F.col("begin") >= min_words)
    return lines.select("doc_id", "key", "pos", "h", "begin", "end", F.when(F.col("room"), F.col("least.h")).alias("print"), F.when(F.col("room"), F.col("least.pos")).alias("place"))


def _ahead(min_words: int):
    """The lines of the window that begins at a line."""
    return Window.partitionBy("doc_id", "key").orderBy("begin").rangeBetween(0, min_words - 1)


def _later(runs: DataFrame) -> DataFrame:
    """runs: doc_id, key, first, last, id_a, id_b (128 bits of their lines).  Those whose lines stand at two places; ``again``: not the first of them."""
    groups = runs.groupBy("id_a", "id_b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "first")).alias("origin"))
    groups = materialise(groups.where("n > 1").select("id_a", "id_b", "origin"))
    again = ~F.struct("doc_id", "key", "first").eqNullSafe(F.col("origin"))
    return runs.join(maybe_broadcast(groups), ["id_a", "id_b"]).select("doc_id", "key", "first", "last", again.alias("again"))


def _around(lines: DataFrame, shared: DataFrame, min_words: int) -> DataFrame:
    """At each line of documents with a shared fingerprint: the window that begins there, if its fingerprint is shared, and the shortest run with enough words that ends there."""
    docs = materialise(lines.join(shared, "print").select(F.col("doc_id").alias("hot_id"), F.col("key").alias("hot_key")).distinct())
    docs = maybe_broadcast(docs)
    near = lines.join(docs, lines["doc_id"].eqNullSafe(docs["hot_id"]) & (lines["key"] == docs["hot_key"]), "left_semi").join(shared, "print", "left")
    behind = Window.partitionBy("doc_id", "key").orderBy("end").rangeBetween(1 - min_words, 0)
    near = near.withColumn("fore", F.collect_list("h").over(_ahead(min_words)))
    near = near.withColumn("back", F.collect_list("h").over(behind)).withColumn("enough", F.col("end") - F.min("begin").over(behind) >= min_words)

    def run(h: str, first: Column, last: Column) -> Column:
        return F.struct(first.alias("first"), last.alias("last"), F.xxhash64(h).alias("id_a"), F.xxhash64(F.lit(7), h).alias("id_b"))

    pos = F.col("pos")
    fore = F.when(F.col("shared"), run("fore", pos, pos + F.size("fore") - 1))
    back = F.when(F.col("enough"), run("back", pos - F.size("back") + 1, pos))
    return near.select("doc_id", "key", fore.alias("fore"), back.alias("back"))


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key, runs (array of first and last line) for documents that lose lines."""
    lines = materialise(fingerprints(docs, min_words))
    # Fingerprints at two places or more, and what stands around those places.
    place = F.struct("doc_id", "key", "place")
    often = lines.where("print IS NOT NULL").groupBy("print").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    shared = maybe_broadcast(materialise(often.where("low <> high").select("print", F.lit(True).alias("shared"))))
    around = materialise(_around(lines, shared, min_words))
    found = materialise(_later(around.where("fore IS NOT NULL").select("doc_id", "key", "fore.*")))
    # To the right: runs that end beyond a repeated window and begin where it begins.
    back = around.where("back IS NOT NULL").select("doc_id", "key", "back.*")
    starts = found.select("doc_id", "key", "first", F.col("last").alias("known")).distinct()
    start = back["doc_id"].eqNullSafe(starts["doc_id"]) & (back["key"] == starts["key"]) & (back["first"] == starts["first"]) & (back["last"] > starts["known"])
    beyond = _later(materialise(back.join(starts, start, "left_semi")))
    spans = found.where("again").unionByName(beyond.where("again")).select("doc_id", "key", "first", "last").distinct()
    # Touching spans of a document become one run.
    before = Window.partitionBy("doc_id", "key").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id", "key").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce(F.col("first") > F.max("last").over(before) + 1, F.lit(True))
    spans = spans.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(upto))
    runs = spans.groupBy("doc_id", "key", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with the columns of ``docs``, their text without later repeated runs, and removed_runs."""
    gone = materialise(deletions(docs, min_words)).select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"), "runs")
    gone = maybe_broadcast(gone)
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (_text_key(docs["text"]) == gone["gone_key"]), "left")
    runs = gone["runs"]
    stays = F.filter(_lines(docs["text"]), lambda x, i: ~F.exists(runs, lambda r: i.between(r["first"], r["last"])))
    text = F.when(runs.isNotNull(), F.array_join(stays, "\n")).otherwise(F.coalesce(docs["text"], F.lit("")))
    removed = F.coalesce(runs, F.array().cast("array<struct<first:int,last:int>>"))
    return joined.select(*(text.alias("text") if c == "text" else docs[c] for c in docs.columns), removed.alias("removed_runs"))


def digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and text_sha256 of what is left."""
    out = deduplicated(docs.select("doc_id", "text", F.size(_lines(F.col("text"))).alias("n_lines")), min_words)
    removed = F.aggregate("removed_runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), removed.alias("n_removed"), F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS pos, lines[i] AS line, trim(lines[i]) AS t FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), w AS (SELECT *, length(t) - length(replace(t, ' ', '')) + 1 AS w FROM l
), s AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) - w AS b, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM w
), f AS (
  SELECT doc_id, pos, b, e, list(t) OVER x AS ft, max(e) OVER x AS fe, list(t) OVER y AS bt, min(b) OVER y AS bb
  FROM s WINDOW x AS (PARTITION BY doc_id ORDER BY b RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING), y AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), g AS (
  SELECT doc_id, pos AS p, pos + len(ft) - 1 AS q, array_to_string(ft, chr(10)) AS body FROM f WHERE fe - b >= 50
  UNION SELECT doc_id, pos - len(bt) + 1, pos, array_to_string(bt, chr(10)) FROM f WHERE e - bb >= 50
), o AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, p) AS k FROM g
), gone AS (SELECT DISTINCT doc_id, unnest(range(p, q + 1)) AS pos FROM o WHERE k > 1
), r AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '') AS text
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_removed, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM r
"""
