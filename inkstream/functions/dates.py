"""Dates with precision and confidence, as Column functions.  The clock is a parameter everywhere."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Confidence levels from the weakest, English month names.
CONFIDENCE = ("unknown", "inferred", "medium", "high", "exact")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)"
_STRUCT = "struct<iso:timestamp_ntz,precision:string,confidence:string,source:string>"
#: What a confidence level tells the reader.
NOTES = {"exact": "", "high": "", "medium": "date read from the page", "inferred": "date estimated", "unknown": "date unknown"}


def confidence_rank(confidence: Column) -> Column:
    """0 (unknown) to 4 (exact); -1 for a missing one."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CONFIDENCE)), confidence), F.lit(0)) - 1, F.lit(-1))


def unknown() -> Column:
    return F.lit(None).cast("timestamp_ntz")


def pub_date(iso: Column, precision: str | Column, confidence: str | Column, source: str | Column) -> Column:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    known = iso.isNotNull()
    return F.struct(
        iso.alias("iso"),
        F.when(known, col(precision)).otherwise("unknown").alias("precision"),
        F.when(known, col(confidence)).otherwise("unknown").alias("confidence"),
        F.when(known, col(source)).otherwise("").alias("source"),
    )


def known(date: Column) -> Column:
    return date["iso"].isNotNull()


def _spelled(year: Column, month: Column, day: Column, time: Column | None, minus_minutes: Column | None) -> Column:
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    text = F.concat(pad(year, 4), F.lit("-"), pad(month, 2), F.lit("-"), pad(day, 2), F.lit(" "), F.lit("00:00:00") if time is None else time)
    at = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return at if minus_minutes is None else at - F.make_dt_interval(mins=minus_minutes)


def _possible(at: Column, now: datetime) -> Column:
    return F.when((F.year(at) >= 1980) & (at <= F.lit(now + timedelta(days=2)).cast("timestamp_ntz")), at)


def moment(year: Column, month: Column, day: Column, now: datetime, time: Column | None = None, minus_minutes: Column | None = None) -> Column:
    """A timestamp; null if the calendar has no such day, or before 1980, or over two days after ``now``."""
    return _possible(_spelled(year, month, day, time, minus_minutes), now)


def _parts(year: Column, month: Column, day: Column, precision: str, confidence: str, source: str, time: Column | None = None, minutes: Column | None = None) -> Column:
    """What a pattern found, to be made a date by ``_dated``."""
    texts = {"year": year, "month": month, "day": day, "time": F.lit("00:00:00") if time is None else time, "precision": F.lit(precision), "confidence": F.lit(confidence), "source": F.lit(source)}
    return F.struct(*(c.cast("string").alias(k) for k, c in texts.items()), (F.lit(0) if minutes is None else minutes).cast("int").alias("minutes"))


def _dated(parts: Column, now: datetime) -> Column:
    """The date of ``parts``.  Binding them keeps the patterns' expressions from being written out once for each use."""
    read = F.transform(F.array(parts), lambda p: F.struct(_spelled(p["year"], p["month"], p["day"], p["time"], p["minutes"]).alias("at"), p["precision"].alias("precision"), p["confidence"].alias("confidence"), p["source"].alias("source")))
    return F.transform(read, lambda x: pub_date(_possible(x["at"], now), x["precision"], x["confidence"], x["source"]))[0]


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).cast("int")


def _month_number(name: Column) -> Column:
    short = F.lower(F.substring(name, 1, 3))
    return F.nullif(F.array_position(F.array(*(F.lit(m[:3].lower()) for m in MONTHS)), short), F.lit(0)).cast("int")


def _offset(sign_and_digits: Column) -> Column:
    """Minutes of +hh:mm, +hhmm; 0 for none."""
    digits = F.regexp_replace(sign_and_digits, "[^0-9]", "")
    minutes = _int(F.substring(digits, 1, 2)) * 60 + F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0))
    return F.coalesce(F.when(sign_and_digits.startswith("-"), -minutes).otherwise(minutes), F.lit(0))


_ISO = r"(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?\s*(Z|z|[+-]\d{2}:?\d{2})?)?"


def _clock(text: Column, pattern: str, hour: int) -> Column:
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")), F.lit("00"))
    return F.concat_ws(":", part(hour), part(hour + 1), part(hour + 2))


def _iso_parts(text: Column, confidence: str, source: str) -> Column:
    g = lambda k: F.regexp_extract(text, _ISO, k)
    minutes = F.when(g(4) != "", _offset(g(7))).otherwise(0)
    found = _parts(g(1), g(2), g(3), "day", confidence, source, _clock(text, _ISO, 4), minutes)
    return F.when(F.regexp_like(text, F.lit(_ISO)), found).otherwise(_freeform_parts(text, confidence, source))


def parse_iso(text: Column, now: datetime, confidence: str = "exact", source: str = "") -> Column:
    """The first ISO date anywhere; without one, as ``parse_freeform``; a bad one is unknown."""
    return _dated(_iso_parts(F.coalesce(text, F.lit("")), confidence, source), now)


_RFC = rf"(?i)(\d{{1,2}})\s+({_MONTH})\w*\s+(\d{{4}})(?:\s+(\d{{2}}):(\d{{2}})(?::(\d{{2}}))?)?(?:\s*([+-]\d{{4}}|GMT|UTC))?"


def parse_rfc822(text: Column, now: datetime, confidence: str = "exact", source: str = "") -> Column:
    """``Thu, 16 Apr 2026 17:25:38 +0000``; anything else as ``parse_iso``."""
    text = F.coalesce(text, F.lit(""))
    g = lambda k: F.regexp_extract(text, _RFC, k)
    offset = F.when(g(7).rlike(r"^[+-]"), _offset(g(7))).otherwise(0)
    found = _parts(g(3), _month_number(g(2)), g(1), "day", confidence, source, _clock(text, _RFC, 4), offset)
    return _dated(F.when(F.regexp_like(text, F.lit(_RFC)), found).otherwise(_iso_parts(text, confidence, source)), now)


_MDY = rf"(?i)\b({_MONTH})\b\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,\s*(\d{{4}})\b"
_DMY = rf"(?i)\b(\d{{1,2}})\s+({_MONTH})\b\.?,?\s+(\d{{4}})\b"
_MY = rf"(?i)\b({_MONTH})\s+(\d{{4}})\b"
_Y = r"\b(19[89]\d|20[0-4]\d)\b"


def _freeform_parts(text: Column, confidence: str, source: str) -> Column:
    g = lambda p, k: F.regexp_extract(text, p, k)
    one = F.lit(1)
    has = lambda p: F.regexp_like(text, F.lit(p))
    return (
        F.when(has(_MDY), _parts(g(_MDY, 3), _month_number(g(_MDY, 1)), g(_MDY, 2), "day", confidence, source))
        .when(has(_DMY), _parts(g(_DMY, 3), _month_number(g(_DMY, 2)), g(_DMY, 1), "day", confidence, source))
        .when(has(_MY), _parts(g(_MY, 2), _month_number(g(_MY, 1)), one, "month", confidence, source))
        .otherwise(_parts(F.coalesce(F.nullif(g(_Y, 1), F.lit("")), F.lit("0000")), one, one, "year", "inferred", source or "text:year-only"))
    )


def parse_freeform(text: Column, now: datetime, confidence: str = "medium", source: str = "") -> Column:
    """``March 5, 2004``, ``5 March 2004``, ``March 2004``, then a bare year (inferred)."""
    return _dated(_freeform_parts(F.coalesce(text, F.lit("")), confidence, source), now)


_URL = r"/((?:19|20)\d{2})/(\d{1,2})(?:/(\d{1,2}))?(?:/|$)"


def parse_from_url(url: Column, now: datetime) -> Column:
    """``/yyyy/m/`` or ``/yyyy/m/d/`` in a path."""
    url = F.coalesce(url, F.lit(""))
    month, day = _int(F.regexp_extract(url, _URL, 2)), _int(F.regexp_extract(url, _URL, 3))
    at = F.when(month.between(1, 12), moment(F.regexp_extract(url, _URL, 1), month, F.coalesce(day, F.lit(1)), now))
    return pub_date(at, F.when(day.isNotNull(), "day").otherwise("month"), "high", "url:permalink")


def window_end(iso: Column, precision: Column) -> Column:
    """The last second that a date of this precision can mean."""
    second = F.expr("INTERVAL '1' SECOND")
    day = F.expr("INTERVAL '1' DAY")
    last = lambda d: d.cast("timestamp_ntz") + day - second
    return F.when(precision == "day", iso + day - second).when(precision == "month", last(F.last_day(iso.cast("date")))).when(precision == "year", last(F.make_date(F.year(iso), F.lit(12), F.lit(31)))).otherwise(iso)


def format_display(iso: Column, precision: Column, confidence: Column) -> Column:
    """``2004``, ``March 2004``, ``5 March 2004``, ``Date unknown``; ``circa`` before an inferred one."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(iso))
    year = F.year(iso).cast("string")
    text = F.when(precision == "year", year).when(precision == "month", F.concat_ws(" ", month, year)).otherwise(F.concat_ws(" ", F.day(iso).cast("string"), month, year))
    text = F.when(confidence == "inferred", F.concat(F.lit("circa "), text)).otherwise(text)
    return F.when(iso.isNull() | (precision == "unknown"), "Date unknown").otherwise(text)


def format_short(iso: Column, precision: Column) -> Column:
    full = F.substring(iso.cast("string"), 1, 10)
    short = F.when(precision == "year", F.substring(full, 1, 4)).when(precision == "month", F.substring(full, 1, 7)).otherwise(full)
    return F.when(iso.isNull() | (precision == "unknown"), "—").otherwise(short)


def confidence_note(confidence: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])[confidence]


def two_digit_year(yy: Column, now: datetime) -> Column:
    return F.when(yy <= now.year % 100 + 1, yy + 2000).otherwise(yy + 1900)


def interpolate(older: Column, newer: Column, source: str = "index:bracketed-neighbours") -> Column:
    """The midnight before the middle of two dates, whichever comes first, known to the month; with one alone, that one, known to the year."""
    a, b = F.least(older, newer), F.greatest(older, newer)
    both = older.isNotNull() & newer.isNotNull()
    middle = F.date_trunc("day", a + (b - a) / 2).cast("timestamp_ntz")
    return pub_date(F.when(both, middle).otherwise(a), F.when(both, "month").otherwise("year"), "inferred", source)


#: Positions of an index that are walked as one piece.
PIECE = 100_000
#: Fixed value: days that neighbours may lie apart.
MOST_APART = 4 * 366
#: Each estimate halves the distance to the older date, rounded down to a day: from ``MOST_APART`` days none is left sooner
#: than this, and the estimate then stays as it is (or fits no more).
HALVINGS = 16


def _neighbours(rows: DataFrame, piece: int) -> DataFrame:
    """``rows`` with newer and older, the known dates before and after a row, and gap: its number among the undated rows after ``newer``.

    An index is cut into pieces by position, each walked by itself.  What a piece can't see, the last known date before it,
    the next one after it and how many undated rows lie between, is carried over from a table of one row for each piece, so
    a source with a long index is many tasks.
    """
    known, seq = F.col("published_at").isNotNull(), F.struct("pos", "published_at")
    keys = ["source_id", "piece"]
    inside = Window.partitionBy(*keys).orderBy("pos", "published_at")
    # What follows is taken by the order turned round: a frame that ends at the last row would be gone through anew for every row.
    turned = Window.partitionBy(*keys).orderBy(F.desc("pos"), F.desc("published_at"))
    upto, beyond = inside.rowsBetween(Window.unboundedPreceding, -1), turned.rowsBetween(Window.unboundedPreceding, -1)
    walked = rows.select("source_id", "pos", "published_at", F.floor(F.col("pos") / piece).alias("piece"))
    walked = walked.withColumn("undated", F.sum((~known).cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    mark = F.struct(F.col("published_at").alias("at"), "undated")
    walked = walked.withColumns({"before": F.last(F.when(known, mark), ignorenulls=True).over(upto), "after": F.last("published_at", ignorenulls=True).over(beyond)})

    ends = walked.groupBy(*keys).agg(
        F.max("undated").alias("held"),
        F.max_by(mark, F.when(known, seq)).alias("last"),
        F.min_by("published_at", F.when(known, seq)).alias("first"),
    )
    earlier = Window.partitionBy("source_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("source_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("base", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    total = F.when(F.col("last").isNotNull(), F.struct(F.col("last.at").alias("at"), (F.col("base") + F.col("last.undated")).alias("undated")))
    ends = ends.select(F.col("source_id").alias("s"), F.col("piece").alias("p"), "base", F.last(total, ignorenulls=True).over(earlier).alias("carried"), F.last("first", ignorenulls=True).over(later).alias("next"))

    out = walked.join(ends, F.col("source_id").eqNullSafe(F.col("s")) & F.col("piece").eqNullSafe(F.col("p")))
    seen = F.when(F.col("before").isNotNull(), F.col("base") + F.col("before.undated")).otherwise(F.col("carried.undated"))
    return out.select(
        "source_id",
        "pos",
        "published_at",
        F.coalesce("before.at", "carried.at").alias("newer"),
        F.coalesce("after", "next").alias("older"),
        (F.col("base") + F.col("undated") - seen).alias("gap"),
    )


def _bracketed(newer: Column, older: Column) -> Column:
    fits = (older <= newer) & (F.datediff(newer, older) <= MOST_APART)
    return F.when(fits, interpolate(older, newer)["iso"])


def bracket_once(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """rows: source_id, pos (numbers along the index, newest first), published_at; back with est.

    Undated ones between an older and a newer neighbour at most four years apart get the middle.  Rows of one position
    are taken by date, undated ones first; rows without a source are one index; other columns don't come back.
    """
    est = F.when(F.col("published_at").isNull(), _bracketed(F.col("newer"), F.col("older")))
    return _neighbours(rows, piece).select("source_id", "pos", "published_at", est.alias("est"))


def bracket_all(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """As ``bracket_once``, but in index order, and an estimate is a neighbour for the rows after it.

    All undated rows of a gap share the older date, so the estimate of the n-th follows from both ends of the gap in n steps.
    """
    steps = F.sequence(F.lit(1), F.least(F.col("gap"), F.lit(HALVINGS)).cast("int"))
    est = F.aggregate(steps, F.col("newer"), lambda at, _: _bracketed(at, F.col("older")))
    return _neighbours(rows, piece).select("source_id", "pos", "published_at", F.when(F.col("published_at").isNull() & (F.col("gap") > 0), est).alias("est"))


def listing_dates(rows: DataFrame, now: datetime) -> DataFrame:
    """rows: page_url, pos, hint.  Dates of a listing's entries.

    A hint that names a date is taken (a bare year only if it is all there is).  Numeric hints (a/b) are
    read for the whole list at once, as year-month, then as month-year: a reading holds if every entry is valid
    and the list is monotone, with three entries or more.
    """
    explicit = parse_iso(F.col("hint"), now, "medium", "archive:index")
    year_only = (explicit["precision"] == "year") & ~F.trim("hint").rlike(r"^\d{4}$")
    rows = rows.withColumn("explicit", F.when(~year_only, explicit["iso"]))
    pair = lambda k: F.regexp_extract("hint", r"^\s*(\d{1,4})\s*[/.-]\s*(\d{1,4})\s*$", k).cast("string")
    a, b = _int(pair(1)), _int(pair(2))
    full = lambda y: F.when(y < 100, two_digit_year(y, now)).otherwise(y)
    read = lambda y, m: F.when(m.between(1, 12), moment(full(y), m, F.lit(1), now))
    rows = rows.withColumn("ym", read(a, b)).withColumn("my", read(b, a)).withColumn("numeric", a.isNotNull())
    lists = rows.where("numeric").groupBy("page_url").agg(F.array_sort(F.collect_list(F.struct("pos", "ym", "my"))).alias("xs"))

    def holds(name: str) -> Column:
        own = F.transform("xs", lambda x: x[name])
        head, tail = F.slice(own, 1, F.size(own) - 1), F.slice(own, 2, F.size(own))
        up = F.forall(F.zip_with(head, tail, lambda p, q: p <= q), lambda x: x)
        down = F.forall(F.zip_with(head, tail, lambda p, q: p >= q), lambda x: x)
        return (F.size(own) >= 3) & F.forall(own, lambda x: x.isNotNull()) & (up | down)

    lists = lists.where(F.size("xs") >= 3).select("page_url", F.when(holds("ym"), "ym").when(holds("my"), "my").alias("reading"))
    out = rows.join(lists, "page_url", "left")
    guess = F.when(F.col("reading") == "ym", F.col("ym")).when(F.col("reading") == "my", F.col("my"))
    return out.select("page_url", "pos", "hint", F.coalesce("explicit", guess).alias("published_at"), F.when(F.col("explicit").isNotNull(), explicit["precision"]).when(guess.isNotNull(), "month").otherwise("unknown").alias("precision"))


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(words / 230.0).cast("int"))


def time_left(words: Column, fraction: Column) -> Column:
    """``5 min left``; nothing read yet gives the whole figure."""
    total = reading_minutes(words)
    left = F.bround(total * (1 - fraction)).cast("int")
    return F.when(fraction <= 0.02, F.concat(total.cast("string"), F.lit(" min"))).when(left < 1, "under a minute left").otherwise(F.concat(left.cast("string"), F.lit(" min left")))
