"""One update of the archive: the run loop, detection of routes anew, limits, progress and cancelling.

A run treats all its sources at once, in steps that are each a plan over whole tables: choose sources, hold
candidates to floors and limits, merge them, take bodies.  Between steps it reports progress and stops
if asked to; what earlier steps recorded stays.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import merge, upsert
from ..sources.plugins import MOST_LIMIT
from ..streaming.incremental import floors, fresh_candidates


@dataclass(frozen=True)
class Progress:
    """What a run has done so far; fraction is null where it can't be told."""

    message: str = ""
    fraction: float | None = None
    new: int = 0
    fetched: int = 0
    failed: int = 0
    done: bool = False
    warnings: tuple[str, ...] = ()


def wanted(sources: DataFrame, source_ids: list[int] | None = None) -> DataFrame:
    """Enabled sources, of the given ones if any are given."""
    rows = sources.where("enabled")
    return rows.where(F.col("source_id").isin(source_ids)) if source_ids else rows


def limits(sources: DataFrame) -> DataFrame:
    """source_id, n from stored options; null (no limit) where there is none or it is unusable."""
    if "config" not in sources.columns:
        return sources.select("source_id", F.lit(None).cast("int").alias("n"))
    options = F.try_parse_json("config")
    whole = F.schema_of_variant(F.try_variant_get(options, "$.limit", "variant")) == "BIGINT"
    n = F.when(whole, F.try_variant_get(options, "$.limit", "int"))
    return sources.select("source_id", F.when(n.between(1, MOST_LIMIT), n).alias("n"))


def with_limit(config: Column, limit: int | None) -> Column:
    """Stored options with another limit; None takes it out.  Junk counts as no options."""
    kind = "map<string,variant>"
    old = F.when(F.try_parse_json(config).isNotNull(), F.from_json(config, kind))
    rest = F.map_filter(F.coalesce(old, F.create_map().cast(kind)), lambda k, _: k != "limit")
    if limit is None:
        return F.to_json(rest)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit("limit"), F.parse_json(F.lit(str(int(limit)))))))


def redetected(stored: Column, found: Column, detected: Column) -> Column:
    """Options after a route was detected anew: the found ones, with the stored section and limit kept."""
    kind = "map<string,variant>"
    empty = F.create_map().cast(kind)
    old, new = F.coalesce(F.from_json(stored, kind), empty), F.coalesce(F.from_json(found, kind), empty)
    section = F.map_filter(old, lambda k, _: (k == "path_prefix") & ~F.map_contains_key(new, "path_prefix"))
    kept = F.map_filter(old, lambda k, _: k == "limit")
    rest = F.map_filter(new, lambda k, _: (k != "detected") & ~((k == "limit") & F.map_contains_key(old, "limit")))
    mark = F.create_map(F.lit("detected"), F.to_variant_object(F.array(F.concat(detected, F.lit(" (re-detected)")))))
    mark = F.transform_values(mark, lambda _, v: F.variant_get(v, "$[0]", "variant"))
    return F.to_json(F.map_concat(rest, section, kept, mark))


def redetect(sources: DataFrame, found: DataFrame) -> DataFrame:
    """``sources`` after detection; found: source_id, plugin, homepage, detected, config, error (null: it worked).

    Where it failed only the status and the message change.
    """
    new = found.select("source_id", *(F.col(c).alias(f"f_{c}") for c in ("plugin", "homepage", "detected", "config", "error")), F.lit(True).alias("hit"))
    both = sources.join(new, "source_id", "left")
    worked, failed = F.col("hit") & F.col("f_error").isNull(), F.col("f_error").isNotNull()
    change = {
        "plugin": F.when(worked, F.col("f_plugin")),
        "homepage": F.when(worked, F.col("f_homepage")),
        "config": F.when(worked, redetected(F.col("config"), F.col("f_config"), F.col("f_detected"))),
        "last_status": F.when(failed, F.lit("error")),
        "last_message": F.when(failed, F.substring("f_error", 1, 500)),
    }
    return both.select(*(F.coalesce(change[c], F.col(c)).alias(c) if c in change else F.col(c) for c in sources.columns))


def summary(now: Progress, stopped: bool) -> str:
    if stopped:
        return "Stopped"
    if now.warnings:
        return "Finished with problems — " + "; ".join(now.warnings[:3])
    return f"Archive up to date — {now.new} new, {now.fetched} articles retrieved"


class Run:
    """A run that can be cancelled from another thread."""

    def __init__(self, on_progress: Callable[[Progress], None] = lambda _: None):
        self._stop, self._busy, self._tell = threading.Event(), threading.Lock(), on_progress
        self.progress = Progress()

    def cancel(self) -> None:
        self._stop.set()

    def _say(self, **change) -> None:
        self.progress = replace(self.progress, **change)
        try:
            self._tell(self.progress)
        except Exception as error:  # a listener's failure is not the run's
            self.progress = replace(self.progress, warnings=(*self.progress.warnings, f"progress listener: {error}"))
            self._tell = lambda _: None

    def sync(
        self, articles: DataFrame, sources: DataFrame, candidates: DataFrame, save: Callable[[str, DataFrame], DataFrame], bodies: DataFrame | None = None,
        source_ids: list[int] | None = None, newest_only: bool = False,
    ) -> DataFrame:
        """The archive's articles after the run.

        candidates: source_id, guid and fields of articles, one row a guid, and failed (a message) on rows that
        stand for a source that couldn't be read.  bodies: source_id, guid and fields of retrieved bodies.
        ``save`` writes a table under a name and reads it again.
        """
        if not self._busy.acquire(blocking=False):
            self._tell(Progress(message="A sync is already running", done=True))
            return articles
        try:
            self._stop.clear()
            self.progress = Progress()
            self._say(message="Choosing sources", fraction=0.0)
            own = wanted(sources, source_ids)
            rows = candidates.join(own.select("source_id"), "source_id", "left_semi")
            if "failed" in rows.columns:
                bad = rows.where("failed IS NOT NULL").agg(F.count("*").alias("n"), F.min("failed").alias("first")).first()
                if bad["n"]:
                    self._say(failed=bad["n"], warnings=(bad["first"],) if bad["n"] == 1 else (bad["first"], f"{bad['n'] - 1} more sources failed"))
                rows = rows.where("failed IS NULL").drop("failed")
            if newest_only:
                rows = fresh_candidates(rows, articles, floors(articles))
            known = articles.select("source_id", "guid", F.lit(True).alias("known"))
            rows = rows.join(known, ["source_id", "guid"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
            rows = merge.within_limits(rows, limits(own), MOST_LIMIT)
            if not self._stop.is_set():
                self._say(message="Recording articles", fraction=0.3)
                rows = save("candidates", rows)
                articles = save("articles", upsert.upsert_articles(articles, rows.drop("known")))
                self._say(new=rows.where("NOT known").count())
            if bodies is not None and not self._stop.is_set():
                self._say(message="Retrieving articles", fraction=0.6)
                taken = bodies.join(own.select("source_id"), "source_id", "left_semi").join(articles.select("source_id", "guid", "content_status"), ["source_id", "guid"])
                taken = save("bodies", taken.where(F.col("content_status").isin("pending", "error") | F.col("content_status").isNull()).drop("content_status"))
                fields = [c for c in taken.columns if c not in ("source_id", "guid")]
                new = taken.select("source_id", "guid", F.lit(True).alias("hit"), F.lit("ok").alias("t_content_status"), *(F.col(c).alias(f"t_{c}") for c in fields))
                both = articles.join(new, ["source_id", "guid"], "left")
                put = [F.when(F.col("hit"), F.col(f"t_{c}")).otherwise(F.col(c)).alias(c) if c in (*fields, "content_status") else F.col(c) for c in articles.columns]
                articles = save("articles_with_bodies", both.select(*put))
                self._say(fetched=taken.count())
            self._say(message=summary(self.progress, self._stop.is_set()), fraction=1.0, done=True)
            return articles
        finally:
            self._busy.release()
