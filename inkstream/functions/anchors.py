"""Where a highlighted quote stands in its article's text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: places of a quote that are compared.
MOST_HITS = 201
#: Quotes of an article that are looked for in one pass over its text.
QUOTES_A_PASS = 1_000


def _flat(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "")


def _best(flat: str, hits: list[int], length: int, prefix: str | None, suffix: str | None, hint: int | None) -> int | None:
    """The best of ``hits`` by what stands before (last 32) and after (first 32), then by nearness to the hint; the first of equals."""
    prefix, suffix = _flat(prefix)[-32:].strip(), _flat(suffix)[:32].strip()
    best, score = None, None
    for at in hits:
        own = -abs(at - (hint or 0)) / 10_000
        # White space between the parts is no more than one character once collapsed.
        if prefix and flat[max(0, at - len(prefix) - 1) : at].rstrip().endswith(prefix):
            own += 1000
        if suffix and flat[at + length : at + length + len(suffix) + 1].lstrip().startswith(suffix):
            own += 1000
        if score is None or own > score:
            best, score = at, own
    return best


def locate(text: str, quote: str, prefix: str = "", suffix: str = "", hint: int = 0) -> int | None:
    """The best place of one quote among its first 201."""
    flat, needle = _flat(text), _flat(quote).strip()
    hits: list[int] = []
    at = flat.find(needle) if needle else -1
    while at >= 0 and len(hits) < MOST_HITS:
        hits.append(at)
        at = flat.find(needle, at + 1)
    return _best(flat, hits, len(needle), prefix, suffix, hint)


def locate_many(text: str, quotes: list[tuple]) -> list[int | None]:
    """``locate`` for many (quote, prefix, suffix, hint) of one text, which is read once: all quotes are one automaton's patterns."""
    flat = _flat(text)
    needles = [_flat(q[0]).strip() for q in quotes]
    hits: dict[str, list[int]] = {n: [] for n in needles if n}
    found = ahocorasick.Automaton()
    for n in hits:
        found.add_word(n, n)
    if hits:
        found.make_automaton()
        for end, n in found.iter(flat):
            if len(hits[n]) < MOST_HITS:
                hits[n].append(end - len(n) + 1)
    return [_best(flat, hits.get(n, []), len(n), prefix, suffix, hint) for n, (_, prefix, suffix, hint) in zip(needles, quotes, strict=True)]


def located(text: Column, quote: Column, prefix: Column, suffix: Column, hint: Column) -> Column:
    """``locate`` for columns, in Arrow batches."""

    @F.pandas_udf("int")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            rows = zip(*(c.where(c.notna(), None) for c in columns), strict=True)
            yield pd.Series([locate(t, q, p, s, int(h) if h is not None and h == h else 0) for t, q, p, s, h in rows], dtype="Int32")

    return run(text, quote, prefix, suffix, hint)


def locate_once(text: Column, quote: Column) -> Column:
    """For quotes that occur once at most, without Python: the place after white space is collapsed."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    return F.nullif(F.position(F.trim(F.regexp_replace(quote, r"(?U)\s+", " ")), flat) - 1, F.lit(-1)).cast("int")


def by_text(highlights: DataFrame, quotes_a_pass: int = QUOTES_A_PASS) -> DataFrame:
    """article_id, pass, own: the highlights of an article that one pass over its text looks for."""
    many = highlights.groupBy("article_id").agg(F.ceil(F.count("*") / quotes_a_pass).alias("passes")).where("passes > 1")
    one = highlights.select("article_id", "highlight_id", "quote", "prefix", "suffix", F.col("start_offset").alias("hint"))
    dealt = one.join(many, "article_id", "left").withColumn("pass", F.pmod(F.xxhash64("highlight_id"), F.coalesce("passes", F.lit(1))))
    return dealt.groupBy("article_id", "pass").agg(F.collect_list(F.struct("highlight_id", "quote", "prefix", "suffix", "hint")).alias("own"))


def located_in(highlights: DataFrame, articles: DataFrame, quotes_a_pass: int = QUOTES_A_PASS) -> DataFrame:
    """highlight_id, at: where each quote stands in its article's text; null where it doesn't.

    highlights: highlight_id, article_id, quote, prefix, suffix, start_offset; articles: article_id, body (other columns are left).
    An article's quotes come to its text together, in passes of about ``quotes_a_pass`` by a hash, so a text is moved and read once for
    each pass and not for each quote, and an article with very many highlights is several tasks.  A quote that is empty or null isn't
    found, nor is any in a null text; highlights of articles that aren't there don't come back.
    """

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, quotes in parts:
            yield pd.Series([locate_many(t, [(q["quote"], q["prefix"], q["suffix"], q["hint"]) for q in own]) for t, own in zip(texts, quotes, strict=True)], dtype="object")

    found = by_text(highlights, quotes_a_pass).join(articles.select("article_id", "body"), "article_id")
    found = found.select("own", run(F.col("body"), F.col("own")).alias("at"))
    return found.select(F.inline(F.arrays_zip(F.col("own.highlight_id").alias("highlight_id"), F.col("at"))))
