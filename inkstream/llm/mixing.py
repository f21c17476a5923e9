"""An order that mixes sources to target weights, by Pfair scheduling of blocks.

A source's documents, in the order of a hash of their id and text, are cut into blocks of ``block_chars`` code points.
With weight w (its share of the sum), block j of a source (from 0) is released at slot floor(j / w) and due by
slot ceil((j + 1) / w); one block is taken a slot, the released one with the earliest deadline first.
At any slot each source is then less than one block from its target share, while it lasts.  A source that ends
early leaves its later slots empty; the others keep their places, so no document is dropped or repeated.

Weights are whole numbers, so the schedule repeats.  Sources of one weight are scheduled as one: with c of them, the
group's block k is block k // c of its member k % c, whose window holds the group's, so releases and deadlines are kept.
One period of the groups is worked out on the driver (the sum of their weights without their common factor, at most
``MOST_SLOTS`` slots; that many sources of one weight take a slot alone); blocks find their slot in it by arithmetic.

Sums along a source are taken in three levels: within hash buckets of about ``bucket_rows`` rows, over the totals of
``FAN`` buckets, and over theirs, so a source with any share of all rows is spread over tasks.

Null sources are the source ''.  Sources without a given weight get ``default``.  A null or empty text takes no
room: it goes with the block that is open there.  Ties of the hash go by id, then size.  Empty tables: no rows.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise, maybe_broadcast

#: Target weights of the registered query; other sources have weight 1.
WEIGHTS = {"src0": 4, "src1": 3, "src2": 2}
BLOCK_CHARS, BUCKET_ROWS, FAN, MOST_SLOTS = 65_536, 2_048, 10, 2_000_000  # FAN: in bits


def schedule(weights: dict[str, int]) -> list[str]:
    """The source served in each slot of one period."""
    if any(w < 1 or w != int(w) for w in weights.values()):
        raise ValueError("weights are whole numbers of 1 or more")
    total = sum(weights.values())
    if total > MOST_SLOTS:
        raise ValueError(f"weights sum to {total}; at most {MOST_SLOTS} slots are worked out")
    waiting = [(0, name, 0) for name in sorted(weights)]  # release, source, block
    ready: list[tuple[int, int, str, int]] = []
    heapq.heapify(waiting)
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, name, j = heapq.heappop(waiting)
            w = weights[name]
            deadline = -(-(j + 1) * total // w)
            # Equal deadlines: first the one whose next block's window overlaps this one (it has less slack).
            overlap = deadline - (j + 1) * total // w
            heapq.heappush(ready, (deadline, -overlap, name, j))
        _, _, name, j = heapq.heappop(ready)
        out.append(name)
        heapq.heappush(waiting, ((j + 1) * total // weights[name], name, j + 1))
    return out


def plan(docs: DataFrame, weights: dict[str, int] | None = None, default: int = 1, block_chars: int = BLOCK_CHARS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, block, release, deadline, slot, seq: documents in the order of (slot, seq)."""
    return _plan(docs, weights, default, block_chars, bucket_rows).drop("name")


def _name(docs: DataFrame) -> Column:
    """128 bits of the text: with id and source it tells rows apart."""
    return F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))


def _plan(docs: DataFrame, weights: dict[str, int] | None = None, default: int = 1, block_chars: int = BLOCK_CHARS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    size = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    # By id and text, so that rows without an id, or of one id, are spread like all others.
    rows = materialise(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("h"), _name(docs).alias("name")))
    members, period, total, slots = _groups(rows, WEIGHTS if weights is None else weights, default, bucket_rows)

    # A bucket is given by the hash's upper bits, so (bucket, h) is the order of h.
    buckets = max(1, -(-rows.count() // bucket_rows))
    rows = rows.withColumn("bucket", _bucket("h", buckets))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "name").rowsBetween(Window.unboundedPreceding, -1)
    sums = _before(rows.groupBy("source", "bucket").agg(F.sum("size").alias("all")), "source")
    placed = rows.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(maybe_broadcast(sums), ["source", "bucket"])
    placed = placed.withColumn("begin", F.col("base") + F.col("own")).withColumn("block", F.floor(F.col("begin") / block_chars).cast("long"))

    placed = placed.join(maybe_broadcast(members), "source").withColumn("k", F.col("block") * F.col("of") + F.col("member"))
    placed = placed.withColumn("turn", F.col("k") % F.col("turns")).withColumn("round", F.expr("k div turns"))
    placed = placed.join(maybe_broadcast(period), ["group", "turn"])
    return placed.select(
        "doc_id",
        "source",
        "block",
        F.expr(f"block * {total}L div weight").alias("release"),
        F.expr(f"((block + 1) * {total}L + weight - 1) div weight").alias("deadline"),
        (F.col("round") * slots + F.col("at")).cast("long").alias("slot"),
        (F.col("begin") - F.col("block") * block_chars).cast("long").alias("seq"),
        "name",
    )


def _bucket(h: str, buckets: int) -> Column:
    bits = max(0, (buckets - 1).bit_length())
    return F.shiftright(h, 64 - bits) if bits else F.lit(0).cast("long")


def _before(sums: DataFrame, key: str) -> DataFrame:
    """key, bucket, base: the sum of ``all`` over the buckets before, in two levels."""
    sums = materialise(sums.withColumn("part", F.shiftright("bucket", FAN)))
    upto = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy(key, "part").agg(F.sum("all").alias("whole"))
    parts = parts.select(key, "part", F.coalesce(F.sum("whole").over(upto([key], "part")), F.lit(0)).alias("far"))
    near = sums.withColumn("near", F.coalesce(F.sum("all").over(upto([key, "part"], "bucket")), F.lit(0)))
    return materialise(near.join(parts, [key, "part"]).select(key, "bucket", (F.col("near") + F.col("far")).alias("base")))


def _groups(rows: DataFrame, weights: dict[str, int], default: int, bucket_rows: int) -> tuple[DataFrame, DataFrame, int, int]:
    """source with weight, group, member, of, turns; the groups' period (group, turn, at); the sum of all weights; the period's slots."""
    spark = rows.sparkSession
    named = spark.createDataFrame([(k, int(w)) for k, w in weights.items()], "source string, own long")  # a parameter's size
    sources = rows.select("source").distinct().join(F.broadcast(named), "source", "left").select("source", F.coalesce("own", F.lit(default)).cast("long").alias("weight"))
    sources = materialise(sources.withColumn("h", F.xxhash64("source")))
    # As many groups as weights were given, and one.
    groups = sources.groupBy("weight").agg(F.count("*").alias("of"), F.min("source").alias("group")).collect()
    if any(g["weight"] < 1 for g in groups):
        raise ValueError("weights are whole numbers of 1 or more")
    total = sum(g["weight"] * g["of"] for g in groups)
    common = math.gcd(*(g["weight"] * g["of"] for g in groups)) if groups else 1
    turns = {g["group"]: g["weight"] * g["of"] // common for g in groups}
    order = schedule(turns) if turns else []
    seen = dict.fromkeys(turns, 0)
    period = []
    for slot, name in enumerate(order):
        period.append((name, seen[name], slot))
        seen[name] += 1
    period = materialise(spark.createDataFrame(period, "group string, turn long, at long"))
    # A source's number in its group, in two levels as well.
    buckets = max(1, -(-sum(g["of"] for g in groups) // bucket_rows))
    sources = sources.withColumn("bucket", _bucket("h", buckets))
    base = _before(sources.groupBy("weight", "bucket").agg(F.count("*").alias("all")), "weight")
    own = F.row_number().over(Window.partitionBy("weight", "bucket").orderBy("h", "source")) - 1
    table = spark.createDataFrame([(g["weight"], g["group"], g["of"], turns[g["group"]]) for g in groups], "weight long, group string, of long, turns long")
    members = sources.withColumn("own", own).join(base, ["weight", "bucket"]).join(F.broadcast(table), "weight")  # a row for each weight
    return materialise(members.select("source", "weight", "group", (F.col("own") + F.col("base")).alias("member"), "of", "turns")), period, total, len(order)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents with the columns of ``docs``, and mix_block, mix_slot and mix_seq to read them by.

    Rows that share id, source and text take the earliest of their places.
    """
    key = (F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("name").alias("mix_name"))
    place = _plan(docs, **how).groupBy(*key).agg(F.min(F.struct("slot", "seq", "block")).alias("place"))
    place = maybe_broadcast(materialise(place))
    same = docs["doc_id"].eqNullSafe(place["mix_id"]) & (F.coalesce(docs["source"], F.lit("")) == place["mix_source"]) & (_name(docs) == place["mix_name"])
    joined = docs.join(place, same)
    return joined.select(*(docs[c] for c in docs.columns), place["place"]["block"].alias("mix_block"), place["place"]["slot"].alias("mix_slot"), place["place"]["seq"].alias("mix_seq"))
