"""Exact duplicates by a 128-bit content hash, with the bytes compared inside groups.

DataFrame functions only.  Texts are equal when identical after white space (space and 0x09-0x0D) is
deleted; null counts as empty.  Of equal texts the row with the most code points stays, then the smallest
id.  Rows that share id and text count each, and are marked alike; ``kept`` leaves one row of each group, of equal ids the
longest.  A null id sorts first.  An empty table gives an empty result.  Extra columns of the input are ignored.

Only (id, hashes, length) are shuffled for all rows.  Texts move for rows whose hash occurs more than once,
to compare bytes; that comparison drops equal texts on the map side, so a group of copies of any size costs
each task one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise, maybe_broadcast

SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def duplicates(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = normalised(F.col("text"))
    keys = materialise(
        docs.select(
            "doc_id",
            hashed(norm).alias("h"),
            F.sha2(norm, 256).alias("text_sha256"),
            F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("size"),
        )
    )
    best = F.min(F.struct((-F.col("size")).alias("less"), F.col("doc_id"))).alias("best")
    groups = keys.groupBy("h").agg(F.count("*").alias("group_size"), best)
    several = materialise(groups.where("group_size > 1"))
    clashes = _clashes(docs, hashed, several, norm)
    n_clashes = clashes.count()

    # h is a plain column of a written table on both sides, so the join is dealt anew and skew can be split.
    out = keys.join(maybe_broadcast(several), "h", "left")
    alone = F.col("group_size").isNull()
    result = out.select(
        "h",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
    )
    if n_clashes:
        clashes = maybe_broadcast(clashes, n_clashes)
        result = result.join(clashes, "h", "left_anti").unionByName(_by_bytes(docs, hashed, clashes, norm, best))
    return result.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _clashes(docs: DataFrame, hashed: Callable, several: DataFrame, norm: Column) -> DataFrame:
    """Hashes under which texts of different bytes stand; no id is needed, so rows without one are compared as well."""
    texts = docs.select(hashed(norm).alias("h"), norm.alias("norm")).join(maybe_broadcast(several.select("h")), "h", "left_semi")
    return materialise(texts.distinct().groupBy("h").count().where("count > 1").select("h"))


def _by_bytes(docs: DataFrame, hashed: Callable, clashes: DataFrame, norm: Column, best: Column) -> DataFrame:
    """Groups by the text itself, for hashes that clash."""
    rows = materialise(
        docs.select("doc_id", hashed(norm).alias("h"), norm.alias("norm"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("size")).join(clashes, "h")
    )
    groups = materialise(rows.groupBy("norm").agg(F.count("*").alias("group_size"), best))
    return rows.join(groups, "norm").select(
        "h", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", F.sha2("norm", 256).alias("text_sha256")
    )


def kept(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs``."""
    found = materialise(duplicates(docs, hashed))
    gone = found.where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_text")).distinct()
    # Rows that share id and text are told apart below; they are combined on the map side.
    twice = found.where("kept").groupBy(F.col("doc_id").alias("twice_id"), F.col("text_sha256").alias("twice_text")).count().where("count > 1").drop("count")
    gone, twice = maybe_broadcast(materialise(gone)), materialise(twice)
    sha = F.sha2(normalised(docs["text"]), 256)
    # By id and text: rows without an id, or of one id, are as many keys as texts.
    out = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (sha == gone["gone_text"]), "left_anti").select(*(docs[c] for c in docs.columns))
    n = twice.count()
    if not n:
        return out
    few = maybe_broadcast(twice, n)
    longest = F.struct(F.coalesce(F.char_length(out["text"]), F.lit(0)), F.md5(F.coalesce(out["text"], F.lit(""))))
    rows = out.select(F.struct(*(out[c] for c in docs.columns)).alias("row"), longest.alias("size"), out["doc_id"].alias("own_id"), F.sha2(normalised(out["text"]), 256).alias("own_text"))
    same = rows["own_id"].eqNullSafe(few["twice_id"]) & (rows["own_text"] == few["twice_text"])
    one = rows.join(few, same).groupBy("twice_id", "twice_text").agg(F.max_by("row", "size").alias("row"))
    return rows.join(few, same, "left_anti").select("row").unionByName(one.select("row")).select("row.*")


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS size FROM documents
), g AS (
  SELECT norm, first(doc_id ORDER BY size DESC, doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
