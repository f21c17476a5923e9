"""Which articles a view of the archive shows, and prefix search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import READABLE

#: Scopes that keep showing read articles when those are hidden.
EXEMPT = ("read", "favourites", "annotated", "highlighted", "skipped")


def scope_filter(scope: str = "all", include_disabled: bool = False, hide_read: bool = False, source_id: int | None = None) -> Column:
    """A predicate over the joined archive (``queue.joined``); an unknown scope is ``all``."""
    out = F.col("content_status").isin(*READABLE)
    if not include_disabled:
        out = out & F.col("enabled")
    out = out & {
        "unread": F.col("read_at").isNull(),
        "read": F.col("read_at").isNotNull(),
        "favourites": F.col("favourite_at").isNotNull(),
        "skipped": F.col("skipped_at").isNotNull(),
        "annotated": (F.coalesce("note_count", F.lit(0)) > 0) | (F.coalesce("highlight_count", F.lit(0)) > 0),
        "highlighted": F.coalesce("highlight_count", F.lit(0)) > 0,
    }.get(scope, F.lit(True))
    if hide_read and scope not in EXEMPT:
        out = out & F.col("read_at").isNull()
    if scope != "skipped":
        out = out & F.col("skipped_at").isNull()
    if source_id:
        out = out & (F.col("source_id") == source_id)
    return out


def _folded(text: Column) -> Column:
    """Without case and accents."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))).alias("t"), r"\p{M}+", "")


def tokens(*columns: str) -> Column:
    """Runs of letters and digits of several columns, folded."""
    text = F.concat_ws(" ", *columns)
    return F.regexp_extract_all(_folded(F.translate(text, _ACCENTED, _PLAIN)), F.lit(r"[\p{L}\p{N}]+"), 0)


# Accented Latin letters, and the letters they fold to, in the same places.
_ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def query_words(query: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in query.lower().translate(str.maketrans(_ACCENTED, _PLAIN))).split()


def search(query: str, *columns: str) -> Column:
    """Every word of ``query`` begins a word of the columns.  Blank: no filter.  Only punctuation: no row."""
    if not query:
        return F.lit(True)
    words = query_words(query)
    if not words:
        return F.lit(False)
    own = tokens(*columns)
    out = F.lit(True)
    for word in words:
        out = out & F.exists(own, _begins(word))
    return out


def _begins(word: str) -> Callable[[Column], Column]:
    return lambda token: F.startswith(token, F.lit(word))


def word_index(articles: DataFrame, *columns: str) -> DataFrame:
    """An inverted index: token, article_id.  At scale a search joins it instead of reading texts."""
    return articles.select("article_id", F.explode(F.array_distinct(tokens(*columns))).alias("token"))


def search_index(index: DataFrame, query: str) -> DataFrame:
    """article_id of the rows that every word of ``query`` matches."""
    words = query_words(query)
    hits = None
    for word in words:
        own = index.where(F.startswith("token", F.lit(word))).select("article_id").distinct()
        hits = own if hits is None else hits.join(own, "article_id", "left_semi")
    return index.select("article_id").limit(0) if hits is None else hits
