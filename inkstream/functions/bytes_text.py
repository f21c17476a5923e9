"""Bodies of responses to text: decompression, character sets, crawl rules."""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DECLARED = re.compile(rb"""<meta[^>]+?charset\s*=\s*["']?\s*([A-Za-z0-9_:.+-]+)""", re.I)
# Byte order marks, and names that mean windows-1252 on the web.
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
_WESTERN = {"iso8859-1", "ascii", "latin-1", "iso-8859-1", "us-ascii"}


def decompress(body: bytes, encoding: str | None) -> bytes:
    """gzip or deflate (with or without header), cut off or not; anything else as it is."""
    how = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get((encoding or "").strip().lower(), ())
    for bits in how:
        try:
            return zlib.decompressobj(bits).decompress(body)
        except zlib.error:
            continue
    return body


def _codec(name: str | None) -> str | None:
    try:
        found = codecs.lookup((name or "").strip()).name
    except LookupError:
        return None
    return "cp1252" if found in _WESTERN else found


def _utf8(body: bytes) -> bool:
    """Valid UTF-8 with something beyond ASCII; a character cut off at the end is no fault."""
    try:
        codecs.getincrementaldecoder("utf-8")().decode(body)
    except UnicodeDecodeError:
        return False
    return any(b > 127 for b in body)


def decode_body(body: bytes | None, content_type: str | None = None) -> str:
    """A mark wins; valid UTF-8 beats a declared single-byte set; then what is declared; then windows-1252 or UTF-8."""
    if not body:
        return ""
    for mark, name in _MARKS:
        if body.startswith(mark):
            return body.decode(name, "replace")
    header = re.search(r"charset\s*=\s*[\"']?([\w:.+-]+)", content_type or "", re.I)
    inside = _DECLARED.search(body[:4096])
    declared = _codec(header[1] if header else None) or _codec(inside[1].decode("ascii", "ignore") if inside else None)
    if _utf8(body) or declared is None and all(b < 128 for b in body):
        return body.decode("utf-8", "replace")
    return body.decode(declared or "cp1252", "replace")


def decoded(body: Column, content_type: Column, encoding: Column | None = None) -> Column:
    """``decode_body`` for columns, in Arrow batches."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, types, codings in parts:
            yield pd.Series([decode_body(decompress(b, c), t) if b is not None else None for b, t, c in zip(bodies, types, codings, strict=True)])

    return run(body, content_type, F.lit("") if encoding is None else encoding)


def crawl_delay(robots: str | None, agent: str, most: float = 30.0) -> float:
    """Seconds between requests that a robots.txt asks for; a group for the agent replaces the one for all."""
    own: list[float] = []
    common: list[float] = []
    names: list[str] = []
    open_ = False
    mine = False
    for line in (robots or "").splitlines():
        line = line.split("#", 1)[0].strip()
        key, _, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not open_:
                names = []
            names.append(value.lower())
            open_ = True
            mine = mine or (value != "*" and value.lower() in agent.lower())
        elif key:
            open_ = False
            if key == "crawl-delay":
                try:
                    delay = float(value)
                except ValueError:
                    continue
                if any(n != "*" and n and n in agent.lower() for n in names):
                    own.append(delay)
                elif "*" in names:
                    common.append(delay)
    return min(most, max(own if mine else common, default=0.0))
