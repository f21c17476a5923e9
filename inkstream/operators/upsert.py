"""Changes to the archive as functions from one snapshot to the next."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_id", "guid"]
PLAIN, DATES = ("url", "title", "author", "source_order"), ("published_at", "date_precision", "date_confidence", "date_source")


def _last(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))


def upsert_articles(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert new articles; of known ones take what is given.

    A plain field is replaced if the new value isn't null.  The date fields go together, and only if the new
    date is known: any known date replaces the stored one, an unknown one never does.  Bodies stay.
    """
    if "title" in incoming.columns:
        incoming = incoming.withColumn("title", F.nullif(F.col("title"), F.lit("")))
    new = incoming.select(*KEY, *(F.col(c).alias(f"new_{c}") for c in incoming.columns if c not in KEY)).withColumn("arrived", F.lit(True))
    both = current.withColumn("held", F.lit(True)).join(new, KEY, "full")
    dated = F.lit("published_at" in incoming.columns) & (F.col("new_published_at").isNotNull() if "published_at" in incoming.columns else F.lit(False))

    def pick(c: str) -> Column:
        if c in KEY or c not in incoming.columns:
            return F.col(c)
        new_value = F.col(f"new_{c}")
        if c in PLAIN:
            return F.coalesce(new_value, F.col(c)).alias(c)
        if c in DATES:
            return F.when(F.col("held").isNull(), new_value).when(dated, F.coalesce(new_value, F.col(c))).otherwise(F.col(c)).alias(c)
        return F.when(F.col("held").isNull(), new_value).otherwise(F.col(c)).alias(c)

    return both.select(*(pick(c) for c in current.columns))


def update_content(current: DataFrame, bodies: DataFrame, key: str = "article_id") -> DataFrame:
    """Overwrite body, status and counts of articles in ``bodies``."""
    given = [c for c in bodies.columns if c != key]
    both = current.join(bodies.select(key, F.lit(True).alias("hit"), *(F.col(c).alias(f"new_{c}") for c in given)), key, "left")
    return both.select(*(F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in current.columns))


def content_error(status: Column, message: Column) -> Column:
    return F.struct(F.when(status.isin(404, 410, 451), "gone").otherwise("error").alias("content_status"), F.substring(message, 1, 120).alias("content_error"))


def last_wins(current: DataFrame, changes: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Key/value upsert: rejects, definitions, settings."""
    return _last(current.unionByName(changes), keys, by)


def insert_or_ignore(current: DataFrame, new: DataFrame, key: str = "slug") -> DataFrame:
    return current.unionByName(new.dropDuplicates([key]).join(current.select(key), key, "left_anti"), allowMissingColumns=True)


def fold_events(state: DataFrame, events: DataFrame) -> DataFrame:
    """Reading state after events (article_id, at, kind, value timestamp or null): kinds are columns of the state."""
    kinds = ("read_at", "favourite_at", "skipped_at")
    own = events.groupBy("article_id").agg(*(F.max_by(F.struct("value"), F.when(F.col("kind") == k, F.col("at"))).alias(k) for k in kinds))
    own = own.select("article_id", *(F.col(k).alias(f"new_{k}") for k in kinds))
    both = state.join(own, "article_id", "full")
    return both.select(*(F.when(F.col(f"new_{c}").isNotNull(), F.col(f"new_{c}.value")).otherwise(F.col(c)).alias(c) if c in kinds else F.col(c) for c in state.columns))


def auto_read(progress: DataFrame) -> DataFrame:
    """Articles scrolled to the end once (fraction of 0.92 or more)."""
    return progress.groupBy("article_id").agg(F.max("fraction").alias("most")).where("most >= 0.92").select("article_id")


def set_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Note upsert; a blank body deletes."""
    return last_wins(notes, changes, ["article_id"], "updated_at").where(F.trim(F.coalesce("body", F.lit(""))) != "")


def reanchor(highlights: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """found: highlight_id, offset (null: not found).  A lost one is marked once, a found one is clear again."""
    both = highlights.join(found, "highlight_id", "left")
    seen = F.col("offset").isNotNull()
    tried = F.col("tried")
    both = highlights.join(found.withColumn("tried", F.lit(True)), "highlight_id", "left")
    start = F.when(tried & seen, F.greatest("offset", F.lit(0))).otherwise(F.col("start_offset"))
    lost = F.when(tried & seen, F.lit(None)).when(tried, F.coalesce("orphaned_at", now)).otherwise(F.col("orphaned_at"))
    return both.withColumns({"start_offset": start, "orphaned_at": lost}).select(highlights.columns)


def drop_junk(articles: DataFrame, junk: Column, *kept_by: DataFrame) -> DataFrame:
    """Articles without junk; rows with a reading state, a mark or a note stay."""
    safe = None
    for df in kept_by:
        own = df.select("article_id")
        safe = own if safe is None else safe.unionAll(own)
    bad = articles.where(junk).select("article_id")
    bad = bad if safe is None else bad.join(safe, "article_id", "left_anti")
    return articles.join(bad, "article_id", "left_anti")


def cascade(source_id: int, sources: DataFrame, articles: DataFrame, **others: DataFrame) -> dict[str, DataFrame]:
    """All tables after a source is deleted."""
    stays = articles.where(F.col("source_id") != source_id)
    gone = articles.where(F.col("source_id") == source_id).select("article_id")
    out = {"sources": sources.where(F.col("source_id") != source_id), "articles": stays}
    return out | {name: df.join(gone, "article_id", "left_anti") if "article_id" in df.columns else df.where(F.col("source_id") != source_id) for name, df in others.items()}


def merge_config(stored: Column, updates: Column) -> Column:
    """JSON objects of strings: updates folded into what is stored now."""
    kind = "map<string,string>"
    old, new = F.coalesce(F.from_json(stored, kind), F.create_map().cast(kind)), F.coalesce(F.from_json(updates, kind), F.create_map().cast(kind))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.to_json(F.map_concat(kept, new))


def update_sources(sources: DataFrame, changes: DataFrame, key: str = "source_id") -> DataFrame:
    """Rename (blank ignored), enable, change the route, record a result (message cut to 500)."""
    given = [c for c in changes.columns if c != key]
    both = sources.join(changes.select(key, *(F.col(c).alias(f"new_{c}") for c in given)), key, "left")

    def pick(c: str) -> Column:
        if c not in given:
            return F.col(c)
        new = F.nullif(F.trim(F.col(f"new_{c}")), F.lit("")) if c in ("name", "source_name") else F.col(f"new_{c}")
        new = F.substring(new, 1, 500) if c == "last_message" else new
        return F.coalesce(new, F.col(c)).alias(c)

    return both.select(*(pick(c) for c in sources.columns))


def teaser(source: Column, status: Column, words: Column) -> Column:
    """Feed bodies too short to be the article are fetched again."""
    return (source == "feed") & status.isin("ok", "partial") & (words < 50)


def body_wanted(status: Column, has_body: Column, refresh: Column) -> Column:
    return status.isin("pending", "error") | ((status == "gone") & has_body) | refresh


def pending_content(articles: DataFrame, sources: DataFrame, limit: int, source_id: int | None = None) -> DataFrame:
    rows = articles.where(F.col("content_status").isin("pending", "error"))
    if source_id:
        rows = rows.where(F.col("source_id") == source_id)
    return rows.join(sources, "source_id").orderBy(F.col("published_at").desc_nulls_last(), "article_id").limit(limit)


def vanished(old: DataFrame, new: DataFrame, used: DataFrame) -> DataFrame:
    """What becomes of chapters that a new edition lacks.

    old: article_id, source_id, title, source_order; new alike; used: article_id with user data.  Equal normalised
    titles are matched one to one, each old chapter (in order) taking the nearest new one that is left.  Returns
    article_id, action (move, keep, delete), target, source_order.
    """
    number = lambda c: F.col(c).cast("long").alias(c)
    norm = lambda d, new: d.select("source_id", F.lower(F.trim(F.regexp_replace("title", r"\s+", " "))).alias("t"), F.lit(new).alias("new"), number("source_order"), number("article_id"))
    both = norm(old, False).unionByName(norm(new, True))
    # A group is the chapters of one title in one book.  The window lays groups one after another, each in order, so a task walks through
    # all of its groups in one pass and holds the numbers of one.
    begins = F.row_number().over(Window.partitionBy("source_id", "t").orderBy("new", F.coalesce("source_order", F.lit(0)), "article_id")) == 1
    found = both.select(begins.alias("begins"), "new", "source_order", "article_id").mapInArrow(_matched, "article_id long, source_order long, target long")
    rows = found.join(used.select("article_id", F.lit(True).alias("used")).distinct(), "article_id", "left")
    action = F.when(F.col("target").isNotNull(), "move").when(F.col("used"), "keep").otherwise("delete")
    order = F.when(action == "keep", F.col("source_order") + 1_000_000).otherwise(F.col("source_order"))
    return rows.select(F.col("article_id").cast(old.schema["article_id"].dataType), action.alias("action"), "target", order.alias("source_order"))


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of old chapters with their target; groups come whole, begun by ``begins``, the old ones first, both in order."""

    def packed() -> pa.RecordBatch:
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(orders, pa.int64()), pa.array(targets, pa.int64())], names=["article_id", "source_order", "target"])

    def settle() -> None:
        ids.extend(old[1])
        orders.extend(old[0])
        targets.extend(_nearest(*old, *new) if new[1] and old[1] else [None] * len(old[1]))

    ids, orders, targets, old, new = [], [], [], ([], []), ([], [])
    for batch in batches:
        for begins, is_new, order, i in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if begins:
                settle()
                old, new = ([], []), ([], [])
            own = new if is_new else old
            own[0].append(order)
            own[1].append(i)
        if len(ids) >= 10_000:
            yield packed()
            ids, orders, targets = [], [], []
    settle()
    yield packed()


def _nearest(old_orders: list, old_ids: list[int], orders: list, ids: list[int]) -> list[int | None]:
    """For each old chapter the nearest new one that is left; an unknown place counts as 0."""
    old_orders, orders = [o or 0 for o in old_orders], [o or 0 for o in orders]  # in order, as unknown ones come where 0 does
    n = len(ids)
    # The free place at or before k, and at or after k, with the ways to them shortened.
    lower, upper = list(range(n + 1)), list(range(n + 1))

    def free(at: int, way: list[int]) -> int:
        root = at
        while way[root] != root:
            root = way[root]
        while way[at] != root:
            way[at], at = root, way[at]
        return root

    out = []
    for o in old_orders:
        k = bisect_left(orders, o)
        after, before = free(k, upper), free(k, lower) - 1  # lower is shifted by one: 0 means none
        if before >= 0:  # of equal orders the first that is free
            before = free(bisect_left(orders, orders[before]), upper)
        best = min((x for x in (before, after) if 0 <= x < n), key=lambda x: (abs(orders[x] - o), x), default=None)
        if best is not None:
            upper[best], lower[best + 1] = best + 1, best
        out.append(None if best is None else ids[best])
    return out


def first_of_digest(images: DataFrame, stored: DataFrame, by: str) -> DataFrame:
    """Images to store: one row per digest, the first, unless it is held."""
    over = Window.partitionBy("digest").orderBy(by)
    return images.withColumn("k", F.row_number().over(over)).where("k = 1").drop("k").join(stored.select("digest"), "digest", "left_anti")


def images_wanted(articles: DataFrame, stored: DataFrame) -> DataFrame:
    """article_id, url of images that bodies show and that aren't held (stored: url); each address once."""
    from ..functions.text import image_urls

    shown = articles.select("article_id", F.explode(image_urls(F.col("content_html"))).alias("url"))
    return shown.groupBy("url").agg(F.min("article_id").alias("article_id")).join(stored.select("url"), "url", "left_anti")
