"""Text as Column functions: words, excerpts, hashes, titles, labels, repair."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that windows-1252 has where Latin-1 has control codes 0x80 to 0x9F.
_C1 = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_CP1252 = bytes(ord(c) for c in _C1).decode("cp1252")
_SPACE = r"(?U)\s+"


def collapse(text: Column) -> Column:
    """White space, wide spaces included, to single blanks."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " "))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->|<[^>]*>", " ")


def word_count(html: Column) -> Column:
    return F.size(F.filter(F.split(strip_tags(html), _SPACE), lambda x: x != ""))


def count_images(html: Column) -> Column:
    return F.regexp_count(F.coalesce(html, F.lit("")), F.lit(r"(?i)<img\b"))


def assess(html: Column) -> Column:
    return F.when(word_count(html) >= 20, "ok").when(count_images(html) >= 1, "ok").otherwise("empty")


def make_excerpt(text: Column, most: int = 260) -> Column:
    """At most 260 characters, cut at a blank, with an ellipsis."""
    flat = collapse(text)
    cut = F.substring(flat, 1, most)
    whole = F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(whole, F.lit("…")))


def content_hash(text: Column) -> Column:
    return F.sha2(F.lower(collapse(text)), 256)


def has_c1(text: Column) -> Column:
    return text.rlike(f"[{_C1}]")


def repair_c1(text: Column) -> Column:
    """Control codes of a wrong decoding to what was meant; untouched (and unscanned) where there are none."""
    return F.when(has_c1(text), F.translate(text, _C1, _CP1252)).otherwise(text)


#: What parts a title from a site's name; the first six with blanks around them.
TITLE_MARKS = ("|", "·", "–", "—", "-", "•")


def clean_title(title: Column, *sites: str) -> Column:
    """A page title without the site's name."""
    out = collapse(title)
    marks = "[" + "".join(re.escape(m) for m in TITLE_MARKS) + "]"
    for site in filter(None, sites):
        affix = rf"(?: {marks} {re.escape(site)}|{re.escape(site)} {marks} )"
        out = F.trim(F.regexp_replace(out, rf"^{affix}|{affix}$", ""))
    parts = F.filter(F.transform(F.split(out, r"\s*[|·•»]\s*"), lambda x: F.trim(x)), lambda x: x != "")
    head, tail = F.array_join(F.slice(parts, 1, F.size(parts) - 1), " | "), F.try_element_at(parts, F.lit(-1))
    site_like = (F.length(head) >= 8) & (F.length(tail) <= 40) & (F.size(F.split(tail, " ")) <= 5)
    out = F.when((F.size(parts) > 1) & site_like, head).otherwise(out)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("Untitled"))


def site_title(title: Column) -> Column:
    """The first part of a home page's title, if it is 2 to 48 characters long."""
    first = F.trim(F.get(F.split(title, r"\s*[|–—·]\s*|\s+-\s+"), 0))
    return F.when(F.length(first).between(2, 48), first)


def note_line(note: Column, mark: Column, most: int = 120) -> Column:
    own = F.nullif(collapse(note), F.lit(""))
    quoted = F.concat(F.lit("“"), F.nullif(collapse(mark), F.lit("")), F.lit("”"))
    line = F.coalesce(own, quoted, F.lit(""))
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…"))).otherwise(line)


def thousands(n: Column) -> Column:
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def byline(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != ""), " · ")


def safe_json(value: Column) -> Column:
    """JSON that can stand in a script element."""
    return F.replace(F.to_json(value), F.lit("</"), F.lit("<\\/"))


def resume_scroll(position: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(position, F.lit(0.0))))


def shows_resume_hint(position: Column) -> Column:
    return resume_scroll(position) > 0.02


def status_notice(status: Column) -> Column:
    return F.when(status == "gone", "This page is gone from its site.").when(status == "error", "The text could not be fetched.").when(status == "empty", "This page has no text.").when(status == "pending", "The text has not been fetched yet.")


def body_lines(html: Column) -> Column:
    """Lines of a page's text, blank ones left out."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), r"(?s)<[^>]*>", "\n")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, _SPACE, " "))), lambda x: x != "")


def dateline(lines: Column) -> Column:
    """A line among the first 14 that begins with a month and a year."""
    return F.get(F.filter(F.slice(lines, 1, 14), lambda x: x.rlike(r"(?i)^(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4}\b")), 0)


def heading_title(title: Column, heading: Column, url: Column) -> Column:
    """A title made from a slug gives way to the text's first heading of 4 to 159 characters."""
    from .urls import slug_title

    made = (title == slug_title(url)) | (title == "Untitled")
    return F.when(made & F.length(F.trim(heading)).between(4, 159), F.trim(heading)).otherwise(title)


def image_urls(html: Column) -> Column:
    """Addresses of images in order, each once, without inline data."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<img\b[^>]*?\bsrc=[\"']([^\"']+)[\"']"), 1)), lambda x: ~F.startswith(x, F.lit("data:")))


#: How image files begin, in hexadecimal.
IMAGE_MAGIC = {"89504E470D0A1A0A": "png", "FFD8FF": "jpg", "474946383761": "gif", "474946383961": "gif"}


def sniff_image(body: Column, mime: Column) -> Column:
    """File type by content, then by declared type; null for what is too small to be a picture."""
    start = F.hex(F.substring(body, 1, 16))
    out = None
    for magic, kind in IMAGE_MAGIC.items():
        hit = F.startswith(start, F.lit(magic))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    out = out.when(F.startswith(start, F.lit("52494646")) & (F.substring(start, 17, 8) == "57454250"), "webp")
    by_type = F.create_map(*[F.lit(x) for x in ("image/png", "png", "image/jpeg", "jpg", "image/gif", "gif", "image/webp", "webp", "image/svg+xml", "svg", "image/avif", "avif")])
    return F.when(F.octet_length(body) >= 900, out.otherwise(by_type[F.lower(F.trim(F.substring_index(mime, ";", 1)))]))


def headword(word: Column) -> Column:
    """A word as a dictionary lists it; null if it isn't one."""
    text = F.replace(collapse(word), F.lit("’"), F.lit("'"))
    text = F.regexp_replace(text, r"(?U)^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    text = F.regexp_replace(F.lower(text), r"'s$", "")
    return F.when(text.rlike(r"^[\p{IsLatin}][\p{IsLatin}'-]{0,40}$"), text)


def definitions(payload: Column, per_meaning: int = 2, most: int = 4) -> Column:
    """English senses of a dictionary answer: at most two of a meaning and four in all, each once."""
    kind = "struct<en:array<struct<partOfSpeech:string,definitions:array<struct<definition:string,examples:array<string>>>>>>"
    clean = lambda x: collapse(strip_tags(x))
    meanings = F.from_json(payload, kind)["en"]
    senses = F.flatten(
        F.transform(
            meanings,
            lambda m: F.slice(
                F.filter(
                    F.transform(m["definitions"], lambda d: F.struct(m["partOfSpeech"].alias("part"), clean(d["definition"]).alias("text"), F.get(F.filter(F.transform(F.coalesce(d["examples"], F.array().cast("array<string>")), clean), lambda x: x != ""), 0).alias("example"))),
                    lambda s: s["text"] != "",
                ),
                1,
                per_meaning,
            ),
        )
    )
    fresh = F.filter(senses, lambda s, i: ~F.exists(F.slice(senses, F.lit(1), i), lambda t: F.lower(t["text"]) == F.lower(s["text"])))
    return F.slice(fresh, 1, most)
