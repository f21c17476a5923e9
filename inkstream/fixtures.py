"""Views of the test tables in the shape of an archive: the same SQL runs here and in the check engine."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents labels benchmark conversations pages embeddings".split()

VIEWS = {
    "fx_sources": """
  SELECT DISTINCT CAST(substring(source, 4) AS BIGINT) AS source_id,
    source AS source_name,
    CAST(substring(source, 4) AS BIGINT) % 9 <> 0 AS enabled
  FROM documents
""",
    "fx_articles": """
  SELECT d.doc_id AS article_id,
    CAST(substring(d.source, 4) AS BIGINT) AS source_id,
    concat('https://', d.source, '.example/', CAST(d.doc_id AS STRING)) AS guid,
    split_part(d.text, '.', 1) AS title,
    d.text AS body,
    CASE WHEN d.doc_id % 10 = 0 THEN NULL WHEN d.doc_id % 10 = 1 THEN CAST(date_trunc('month', o.o_orderdate) AS TIMESTAMP) WHEN d.doc_id % 10 = 2 THEN CAST(date_trunc('year', o.o_orderdate) AS TIMESTAMP) ELSE o.o_orderdate END AS published_at,
    CASE WHEN d.doc_id % 10 = 0 THEN 'unknown' WHEN d.doc_id % 10 = 1 THEN 'month' WHEN d.doc_id % 10 = 2 THEN 'year' ELSE 'day' END AS date_precision,
    CASE WHEN d.doc_id % 10 = 0 THEN 'unknown' WHEN d.doc_id % 4 = 0 THEN 'exact' WHEN d.doc_id % 4 = 1 THEN 'high' WHEN d.doc_id % 4 = 2 THEN 'medium' ELSE 'inferred' END AS date_confidence,
    CASE WHEN d.doc_id % 11 = 0 THEN 'pending' WHEN d.doc_id % 13 = 0 THEN 'error' WHEN d.doc_id % 17 = 0 THEN 'gone' ELSE 'ok' END AS content_status,
    CAST(d.doc_id % 7 AS INT) AS source_order
  FROM documents d
  LEFT JOIN orders o ON o.o_orderkey = d.doc_id
""",
    "fx_reading_state": """
  SELECT l.doc_id AS article_id,
    CASE WHEN l.quality = 1 AND l.doc_id % 2 = 0 THEN o.o_orderdate END AS read_at,
    CASE WHEN l.doc_id % 5 = 0 THEN o.o_orderdate END AS favourite_at,
    CASE WHEN l.toxic = 1 THEN o.o_orderdate END AS skipped_at
  FROM labels l JOIN orders o ON o.o_orderkey = l.doc_id
""",
    "fx_notes": """
  SELECT conv_id AS article_id, text AS body
  FROM conversations
  WHERE turn = 0
""",
    "fx_highlights": """
  SELECT doc_id * 1000 + 1 AS highlight_id,
    doc_id AS article_id,
    substring(text, CAST(21 + doc_id % 50 AS INT), 40) AS quote,
    CASE WHEN doc_id % 3 = 0 THEN 'marked' ELSE '' END AS note,
    CAST(20 + doc_id % 50 AS INT) AS start_offset,
    CAST(NULL AS TIMESTAMP) AS orphaned_at
  FROM documents
  WHERE doc_id % 25 = 0 AND length(text) > 150
  UNION ALL SELECT conv_id * 1000 + 900 + turn AS highlight_id,
    conv_id AS article_id,
    text AS quote,
    '' AS note,
    CAST(turn * 10 AS INT) AS start_offset,
    CASE WHEN turn % 4 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS orphaned_at
  FROM conversations
  WHERE role = 'user' AND turn > 0 AND conv_id % 2 = 0
""",
    "fx_posts": """
  SELECT event_id AS article_id, user_id AS source_id, ts AS published_at
  FROM events
""",
    "fx_routes": """
  SELECT concat('https://blog.example/', CAST(user_id AS STRING), '/', CAST(event_id % 40 AS STRING)) AS guid,
    CASE WHEN event_type IN ('view', 'click') THEN 'archive' WHEN event_type IN ('signup', 'error') THEN 'sitemap' ELSE 'feed' END AS route,
    CASE WHEN event_type IN ('view', 'click') THEN 0 WHEN event_type IN ('signup', 'error') THEN 1 ELSE 2 END AS route_rank,
    event_id AS pos,
    CASE WHEN event_type IN ('signup', 'error') THEN NULL ELSE ts END AS published_at,
    CASE WHEN event_type IN ('view', 'click') THEN 'medium' WHEN event_type = 'purchase' THEN 'exact' ELSE 'unknown' END AS date_confidence,
    CASE WHEN event_type = 'purchase' THEN concat('Post ', CAST(event_id AS STRING)) END AS title
  FROM events
""",
    "fx_source_sync": """
  SELECT user_id AS source_id,
    CASE WHEN user_id % 13 = 0 THEN NULL ELSE TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' HOUR * CAST(user_id % 9 AS INT) END AS last_sync_at FROM (SELECT DISTINCT user_id
  FROM events) u
""",
    "fx_fetch_log": """
  SELECT d.doc_id AS article_id,
    o.o_orderdate AS discovered_at,
    CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE o.o_orderdate + INTERVAL '1' DAY * CAST(d.doc_id % 400 AS INT) END AS content_fetched_at
  FROM documents d JOIN orders o ON o.o_orderkey = d.doc_id
""",
    "fx_rejects": """
  SELECT DISTINCT concat('https://blog.example/', CAST(user_id AS STRING), '/', CAST(event_id % 40 AS STRING)) AS guid,
    CASE WHEN event_id % 100 = 0 THEN 0 ELSE 1 END AS epoch
  FROM events
  WHERE event_id % 50 = 0
""",
    "fx_images": """
  SELECT p_partkey AS image_id,
    concat('img/', CAST(p_partkey AS STRING)) AS relpath,
    CAST(p_size AS BIGINT) * 1000 AS bytes
  FROM part
""",
    "fx_image_refs": """
  SELECT DISTINCT l_partkey AS image_id
  FROM lineitem
  WHERE l_quantity > 48
""",
}


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def with_views(sql: str) -> str:
    """``sql`` with the views that it uses before it."""
    head = ", ".join(f"{v} AS ({VIEWS[v].strip()})" for v in _needs(sql))
    if not head:
        return sql
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{head}, {body[len(start) :]}"
    return f"WITH {head} {body}"


_TITLE = "split_part(d.text, '.', 1)"


def view(spark: SparkSession, sf_dir: str, name: str, **early: Column) -> DataFrame:
    """One of the views over the tables in ``sf_dir``; ``early``: columns of articles beside the view's own, over ``documents``.

    What is made of an article's text, its title and ``early``, is worked out before the join, so whole texts go through it only if ``body`` is wanted.
    """
    spark.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
    sql, frames = VIEWS[name], {}
    if name == "fx_articles":
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"title": F.expr(_TITLE.replace("d.text", "text")), **early})
        sql = sql.replace(_TITLE, "d.title").replace("d.text AS body", ", ".join(["d.text AS body", *(f"d.{c}" for c in early)])).replace("FROM documents d", "FROM {articles} d")
        frames["articles"] = docs
    for t in TABLES:
        new = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", sql)
        if new != sql:
            frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            sql = new
    return spark.sql(sql, **frames)
