"""When a source is due, and when a failed page may be tried again.  The clock is always a parameter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many recent posts tell the pace, seconds between checks, and the share of the pace waited.
RECENT, LEAST, MOST, SHARE = 12, 3600, 3 * 86400, 0.25
#: Back-off after a failure, in seconds and as a share of the time since discovery.
COOL_LEAST, COOL_MOST, COOL_SHARE = 86400, 30 * 86400, 0.5


def seconds(t: Column) -> Column:
    """Seconds of a timestamp without zone; exact, without time zones."""
    return F.unix_seconds(t.cast("timestamp_ltz"))


def cadence(posts: DataFrame) -> DataFrame:
    """source_id, gap: upper median of the seconds between the newest posts; null if fewer than three are dated."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("published_at"), F.desc("article_id"))
    rows = posts.where("published_at IS NOT NULL").withColumn("k", F.row_number().over(newest)).where(F.col("k") <= RECENT)
    rows = rows.withColumn("gap", seconds(F.col("published_at")) - seconds(F.lead("published_at").over(newest)))
    gaps = F.array_sort(F.collect_list("gap"))
    middle = F.try_element_at(gaps, (F.floor(F.size(gaps) / 2) + 1).cast("int"))
    out = rows.groupBy("source_id").agg(F.count("*").alias("n"), middle.alias("gap"))
    return out.select("source_id", F.when(F.col("n") >= 3, F.col("gap")).alias("gap"))


def due(sources: DataFrame, posts: DataFrame, now: datetime) -> DataFrame:
    """source_id, wait (seconds) and due for each source (source_id, last_sync_at, enabled if it has that)."""
    clock = seconds(F.lit(now).cast("timestamp_ntz"))
    pace = cadence(posts).join(posts.groupBy("source_id").agg(F.max("published_at").alias("newest")), "source_id", "left")
    rows = sources.join(pace, "source_id", "left")
    if "enabled" in sources.columns:
        rows = rows.where("enabled")
    quiet = F.greatest("gap", clock - seconds(F.col("newest"))) * SHARE
    wait = F.when(F.col("gap").isNull(), F.lit(float(LEAST))).otherwise(F.least(F.greatest(quiet, F.lit(float(LEAST))), F.lit(float(MOST))))
    since = clock - seconds(F.col("last_sync_at"))
    return rows.select("source_id", wait.alias("wait"), (F.col("last_sync_at").isNull() | (since >= wait)).alias("due"))


def cooling(discovered: Column, tried: Column, now: datetime) -> Column:
    """Whether a failed page is left alone for now; false if it was never tried."""
    clock = seconds(F.lit(now).cast("timestamp_ntz"))
    pause = F.least(F.greatest((seconds(tried) - seconds(discovered)) * COOL_SHARE, F.lit(float(COOL_LEAST))), F.lit(float(COOL_MOST)))
    return F.coalesce((clock - seconds(tried)) < pause, F.lit(False))


def eta(elapsed: Column, fraction: Column, done: Column) -> Column:
    """Seconds left of a run; null when done or hardly begun."""
    return F.when(~done & (fraction >= 0.02), elapsed * (1 - fraction) / fraction)


def hint_fresh(stamp: Column, now: datetime) -> Column:
    """Whether a stored hint is less than seven days old; a bad stamp is stale."""
    at = F.try_to_timestamp(stamp).cast("timestamp_ntz")
    return F.coalesce(seconds(F.lit(now).cast("timestamp_ntz")) - seconds(at) < 7 * 86400, F.lit(False))
