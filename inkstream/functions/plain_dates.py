"""The date rules of ``dates.py`` for single strings, for code that has a page's tree at hand."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from typing import NamedTuple

from .dates import _DMY, _ISO, _MDY, _MY, _URL, _Y


class PlainDate(NamedTuple):
    iso: datetime
    precision: str
    confidence: str
    source: str


_SHORT = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _at(now: datetime, y: str, m: int, d: str, rest: tuple[int, ...] = (), minus: int = 0) -> datetime | None:
    try:
        at = datetime(int(y), m, int(d), *rest) - timedelta(minutes=minus)
    except (ValueError, OverflowError):
        return None
    return at if at.year >= 1980 and at <= now + timedelta(days=2) else None


def _known(at: datetime | None, precision: str, confidence: str, source: str) -> PlainDate | None:
    return None if at is None else PlainDate(at, precision, confidence, source)


def iso(text: str, now: datetime, confidence: str = "exact", source: str = "") -> PlainDate | None:
    m = re.search(_ISO, (text or "").strip())
    if not m:
        return freeform(text, now, confidence, source)
    y, mo, d, hh, mm, ss, tz = m.groups()
    minus = 0
    if tz and tz not in "Zz" and hh:
        digits = tz[1:].replace(":", "")
        minus = (1 if tz[0] == "+" else -1) * (int(digits[:2]) * 60 + int(digits[2:4] or 0))
    return _known(_at(now, y, int(mo), d, (int(hh or 0), int(mm or 0), int(ss or 0)), minus), "day", confidence, source)


def freeform(text: str, now: datetime, confidence: str = "medium", source: str = "") -> PlainDate | None:
    month = lambda name: _SHORT.index(name.lower()[:3]) + 1
    if m := re.search(_MDY, text or ""):
        return _known(_at(now, m[3], month(m[1]), m[2]), "day", confidence, source)
    if m := re.search(_DMY, text or ""):
        return _known(_at(now, m[3], month(m[2]), m[1]), "day", confidence, source)
    if m := re.search(_MY, text or ""):
        return _known(_at(now, m[2], month(m[1]), "1"), "month", confidence, source)
    if m := re.search(_Y, text or ""):
        return _known(_at(now, m[1], 1, "1"), "year", "inferred", source or "text:year-only")
    return None


def from_url(url: str, now: datetime) -> PlainDate | None:
    m = re.search(_URL, url or "")
    if not m or not 1 <= int(m[2]) <= 12:
        return None
    return _known(_at(now, m[1], int(m[2]), m[3] or "1"), "day" if m[3] else "month", "high", "url:permalink")
