"""Command line over an archive's folder: snapshots articles, sources, reading_state, highlights, notes, images."""

from __future__ import annotations

import argparse
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import queue, stats, upsert
from .plans import sync
from .sources import epub, sinks
from .sources.plugins import parse_limit


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    spark.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
    return {t: spark.read.parquet(f"{folder}/{t}") for t in ("articles", "sources", "reading_state", "highlights", "notes", "images")}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="inkstream")
    out.add_argument("--data", required=True, help="folder of snapshots")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("sources")
    commands.add_parser("stats")
    for name in ("queue", "export"):
        own = commands.add_parser(name)
        own.add_argument("--scope", default="all")
        own.add_argument("--order", choices=("oldest", "newest"), default="oldest")
        own.add_argument("--limit", type=parse_limit, default=40)
    commands.choices["export"].add_argument("--content", action="store_true")
    commands.choices["export"].add_argument("--to", required=True)
    for name in ("enable", "disable", "remove"):
        own = commands.add_parser(name)
        own.add_argument("source", type=int)
        own.add_argument("--to", required=True, help="folder for the new snapshots")
    add = commands.add_parser("add", help="a source as detection found it")
    for name in ("homepage", "name", "plugin", "detected"):
        add.add_argument(f"--{name}", required=True)
    add.add_argument("--slug")
    add.add_argument("--config", default="{}", help="options as a JSON object")
    book = commands.add_parser("add-book")
    book.add_argument("path")
    book.add_argument("--name")
    limit = commands.add_parser("set-limit")
    limit.add_argument("source", type=int)
    sync_ = commands.add_parser("sync", help="merge candidates that were read from the sources")
    sync_.add_argument("--candidates", required=True)
    sync_.add_argument("--bodies")
    sync_.add_argument("--source", type=int, action="append")
    sync_.add_argument("--newest", action="store_true")
    prune = commands.add_parser("prune", help="drop images that no body names")
    for own in (add, limit):
        own.add_argument("--limit", type=parse_limit, **({"required": True} if own is limit else {"default": None}))
    for own in (add, book, limit, sync_, prune):
        own.add_argument("--to", required=True, help="folder for the new snapshots")
    rename = commands.add_parser("rename")
    rename.add_argument("source", type=int)
    rename.add_argument("name")
    rename.add_argument("--to", required=True)
    return out


def slug_of(homepage: str) -> str:
    return homepage.split("//")[-1].split("/")[0].removeprefix("www.").replace(".", "-")


def add_source(sources: DataFrame, slug: str, name: str, plugin: str, homepage: str, config: dict) -> DataFrame:
    """``sources`` and the new one, unless its slug is there; its id is the next one."""
    last = sources.agg(F.max("source_id")).first()[0] or 0
    new = sources.sparkSession.createDataFrame([(last + 1, slug, name, plugin, homepage, json.dumps(config), True)], "source_id long, slug string, source_name string, plugin string, homepage string, config string, enabled boolean")
    return upsert.insert_or_ignore(migrate_columns(sources), new.select(*(F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in migrate_columns(sources).schema)))


def migrate_columns(sources: DataFrame) -> DataFrame:
    """``sources`` with the columns that older snapshots lack."""
    for name in ("slug", "plugin", "homepage", "config"):
        if name not in sources.columns:
            sources = sources.withColumn(name, F.lit(None).cast("string"))
    return sources


def add_book(spark: SparkSession, sources: DataFrame, path: str, name: str | None) -> DataFrame:
    """A book is known by where it came from; one that can't be read is refused."""
    path = path if "://" in path else os.path.abspath(os.path.expanduser(path))
    if sources.where((F.col("plugin") == "epub") & (F.coalesce(F.get_json_object("config", "$.origin"), F.col("homepage")) == path)).head(1):
        return sources
    rows = epub.read_books(spark.read.format("binaryFile").load(path).select(F.lit(path).alias("path"), "content"))
    found = rows.agg(F.max("book_title").alias("title"), F.max("sha256").alias("sha256"), F.max("error").alias("error"), F.count("position").alias("parts")).first()
    if found["error"]:
        raise SystemExit(f"Cannot add this book: {found['error']}")
    title = found["title"] or "Untitled"
    base = "book-" + (re.sub("[^a-z0-9]+", "-", title.lower()).strip("-")[:40] or "untitled")
    taken = {r["slug"] for r in sources.where(F.startswith("slug", F.lit(base))).select("slug").collect()}
    slug = next(x for x in (base if n == 1 else f"{base}-{n}" for n in range(1, len(taken) + 2)) if x not in taken)
    config = {"path": path, "origin": path, "sha256": found["sha256"], "detected": f"EPUB file, {found['parts']} chapters"}
    return add_source(sources, slug, (name or "").strip() or title, "epub", path, config)


def set_limit(sources: DataFrame, source_id: int, limit: int | None) -> DataFrame:
    """Follow so many posts (None: all); what is stored stays.  Books are always whole."""
    own = F.col("source_id") == source_id
    if sources.where(own & (F.col("plugin") == "epub")).head(1):
        raise SystemExit("books are always imported whole")
    return sources.withColumn("config", F.when(own, sync.with_limit(F.col("config"), limit)).otherwise(F.col("config")))


def changed(spark: SparkSession, args: argparse.Namespace, t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that a command changes."""
    sources = migrate_columns(t["sources"])
    if args.command == "add":
        config = json.loads(args.config) | {"detected": args.detected} | ({"limit": args.limit} if args.limit else {})
        return {"sources": add_source(sources, args.slug or slug_of(args.homepage), args.name, args.plugin, args.homepage, config)}
    if args.command == "add-book":
        return {"sources": add_book(spark, sources, args.path, args.name)}
    if args.command == "set-limit":
        return {"sources": set_limit(sources, args.source, args.limit)}
    if args.command == "prune":
        return {"images": t["images"].join(stats.image_references(t["articles"]), "relpath", "left_semi").select(t["images"].columns)}

    def save(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{args.to}/_sync/{name}")
        return spark.read.schema(df.schema).parquet(f"{args.to}/_sync/{name}")

    one = sync.Run(lambda p: print(p.message))
    bodies = spark.read.parquet(args.bodies) if args.bodies else None
    return {"articles": one.sync(t["articles"], sources, spark.read.parquet(args.candidates), save, bodies, args.source, args.newest)}


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    """The result of a command; commands that change the archive write new snapshots and return the sources."""
    args = parser().parse_args(argv)
    t = tables(spark, args.data)
    if args.command == "sources":
        return sinks.source_lines(stats.listing(t["sources"], t["articles"]).orderBy(F.lower("source_name")))
    if args.command == "stats":
        return stats.coverage(t["articles"]).crossJoin(stats.library(t["articles"], t["images"]).select("ok", "images", "bytes"))  # the right side is one row
    if args.command in ("queue", "export"):
        archive = queue.joined(*(t[x] for x in ("articles", "sources", "reading_state", "highlights", "notes")))
        rows = queue.queue(archive.withColumn("excerpt", F.col("excerpt") if "excerpt" in archive.columns else F.lit("")), args.scope, args.order == "newest", args.limit)
        if args.command == "queue":
            return sinks.queue_lines(rows)
        out = sinks.export_rows(rows, args.content)
        out.write.mode("overwrite").text(args.to)
        return out
    if args.command in ("add", "add-book", "set-limit", "sync", "prune"):
        new = t | changed(spark, args, t)
    elif args.command == "remove":
        new = upsert.cascade(args.source, t.pop("sources"), t.pop("articles"), **{k: t[k] for k in ("reading_state", "highlights", "notes")}) | {"images": t["images"]}
    else:
        change = {"enable": ("enabled", True), "disable": ("enabled", False), "rename": ("source_name", getattr(args, "name", None))}[args.command]
        changes = spark.range(1).select(F.lit(args.source).cast("long").alias("source_id"), F.lit(change[1]).alias(change[0]))
        new = t | {"sources": upsert.update_sources(t["sources"], changes)}
    for name, df in new.items():
        df.write.mode("overwrite").parquet(f"{args.to}/{name}")
    return new["sources"]


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("inkstream").getOrCreate()
    for row in run(spark, sys.argv[1:]).toLocalIterator():
        print(*row)


if __name__ == "__main__":
    main()
