"""Schemas of the archive's tables, and bringing older snapshots up to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NTZ = T.TimestampNTZType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


L, I, S, D, B = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType()
PUB_DATE = _of(iso=NTZ, precision=S, confidence=S, source=S)
SOURCES = _of(id=L, slug=S, name=S, homepage=S, plugin=S, config=S, enabled=B, last_sync_at=NTZ, last_status=S, last_message=S, added_at=NTZ)
ARTICLES = _of(
    article_id=L, source_id=L, guid=S, url=S, title=S, author=S, published_at=NTZ, date_precision=S, date_confidence=S, date_source=S,
    modified_at=NTZ, source_order=I, discovered_at=NTZ, content_fetched_at=NTZ, content_status=S, content_error=S, content_html=S,
    excerpt=S, word_count=I, image_count=I, content_hash=S,
)
READING_STATE = _of(article_id=L, read_at=NTZ, favourite_at=NTZ, scroll_pos=D, last_opened_at=NTZ, skipped_at=NTZ)
IMAGES = _of(digest=S, relpath=S, url=S, mime=S, bytes=L)
REJECTS = _of(source_id=L, guid=S, epoch=I, seen_at=NTZ)
HIGHLIGHTS = _of(highlight_id=L, article_id=L, quote=S, prefix=S, suffix=S, note=S, start_offset=I, created_at=NTZ, orphaned_at=NTZ)
NOTES = _of(article_id=L, body=S, updated_at=NTZ)
DEFINITIONS = _of(word=S, payload=S, fetched_at=NTZ)
PAGES_RAW = _of(url=S, status=I, headers=T.MapType(S, S), body=T.BinaryType())
SCHEMA_VERSION = 5

#: Article texts that can be read.
READABLE = ("ok", "partial", "paywalled")
#: Version of the rules by which pages are rejected.
REJECT_EPOCH = 1


def migrate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``; missing ones are null, others are kept at the end."""
    have = {f.name for f in df.schema}
    own = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*own, *[c for c in df.columns if c not in schema.names])
