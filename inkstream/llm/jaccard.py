"""Near-duplicate documents: a Jaccard join on word shingles by chosen paths.

A document's set holds its runs of five words (``words.py``); a text of one to four words has one element,
all its words.  Equal sets are joined first and searched once.  A set stands in the search as ``COORDINATES``
min-hash tokens.  In every run, a node of the recursion picks coordinates with a probability of
1 / (threshold * COORDINATES) each and sends a set down the branches of the tokens it has there, so that sets with
the threshold's similarity share one branch a level on average.  Nodes of at most ``bucket`` sets are compared
pair by pair (by their tokens, with slack); larger ones split further.  Nodes that are still large
after ``depth`` levels hold sets alike on every level; all their sets are candidates together.  Runs are repeated
until the expected recall at the threshold is ``recall``.

Candidates form groups.  Inside a group every pair is then verified on the whole sets: groups are cut into
blocks of bounded size, blocks are compared two by two in different tasks by matrix products, and each task
returns a row per set (how many sets it links, and the smallest set it is connected with), never pairs.

Every document gets a row.  Null and empty texts are classes of their own.  Nodes are sets, so rows that share an id but
not a text, and rows without an id, are compared each for itself; an id that is null comes last, and a class of such rows
alone has no id.  Repeated rows give a row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import configure
from . import words as W
from .components import components
from .store import id_type, materialise, maybe_broadcast

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.95
COORDINATES, BUCKET, DEPTH, SLACK = 128, 24, 4, 0.1
BLOCK_SETS, BLOCK_ELEMENTS = 1_000, 500_000

_rng = np.random.default_rng(4711)
_A = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def runs_for(recall: float, depth: int) -> int:
    """Runs until a pair at the threshold meets with this probability, even at the lowest level."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _sets(w: W.Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct elements of each text."""
    ids, _ = w.shingles(k)
    for lo, hi in zip(w.offsets[:-1], w.offsets[1:], strict=True):
        n = hi - lo
        if n >= k:
            yield np.unique(ids[lo : hi - k + 1])
        elif n:
            own = W.Words(w.hashes[lo:hi], w.starts, w.ends, np.array([0, n]), w.data)
            yield own.shingles(int(n))[0][:1]
        else:
            yield np.zeros(0, dtype=np.uint64)


def _signature(elements: np.ndarray) -> bytes:
    low = np.full(COORDINATES, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(elements), 512):  # fits the cache
        x = elements[at : at + 512, None] * _A + _B
        np.minimum(low, (x ^ (x >> np.uint64(29))).min(axis=0), out=low)
    return (W.mix(low) >> np.uint64(48)).astype("<u2").tobytes()


def _name(own: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    two = (W.mix(own).sum(dtype=np.uint64), W.mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
    return np.array(two, dtype=np.uint64).tobytes()


def _describe(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in W.parts(batch, "text"):
                names, sizes, signatures = [], [], []
                for own in _sets(w, shingle):
                    sizes.append(len(own))
                    names.append(_name(own))
                    signatures.append(_signature(own) if len(own) else b"")
                yield pa.record_batch([rows.column("doc_id"), rows.column("text_name"), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())], names=["doc_id", "text_name", "name", "size", "signature"])

    return docs.select("doc_id", F.md5("text").alias("text_name"), "text").mapInArrow(run, f"doc_id {id_type(docs)}, text_name string, name binary, size long, signature binary")


def _children(path: np.ndarray, signatures: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows go on, and the paths they go on to."""
    at = np.arange(COORDINATES, dtype=np.uint64)
    draw = W.mix(path[:, None] + W.mix(at + np.uint64(1)))
    row, i = np.nonzero(draw < np.uint64(int(2.0**64 / (threshold * COORDINATES))))
    return row, W.mix(draw[row, i] + W.mix(signatures[row, i].astype(np.uint64) + np.uint64(7)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, COORDINATES)


def _first_level(sets: DataFrame, runs: int, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, ids = _matrix(batch.column("signature")), batch.column("node").to_numpy()
                for r in range(runs):
                    row, path = _children(np.full(len(own), W.mix(np.array([r + 1], np.uint64))[0]), own, threshold)
                    yield pa.record_batch([pa.array(ids[row]), pa.array(path.view(np.int64))], names=["node", "path"])

    return sets.select("node", "signature").mapInArrow(run, "node long, path long")


def _next_level(rows: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, path = _children(batch.column("path").to_numpy().view(np.uint64), _matrix(batch.column("signature")), threshold)
                yield pa.record_batch([pa.array(batch.column("node").to_numpy()[row]), pa.array(path.view(np.int64))], names=["node", "path"])

    return rows.select("node", "path", "signature").mapInArrow(run, "node long, path long")


def _compare_small(rows: DataFrame, bucket: int, least: float) -> DataFrame:
    """Pairs of sets of one small node with enough equal tokens; rows come ordered by path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if rest is not None and rest.num_rows:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            path = batch.column("path").to_numpy()
            done = int(np.searchsorted(path, path[-1], "left")) if len(path) else 0
            rest = batch.slice(done)
            yield pairs(batch.slice(0, done))
        if rest is not None and rest.num_rows:
            yield pairs(rest)

    def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if batch.num_rows:
            path, node, own = batch.column("path").to_numpy(), batch.column("node").to_numpy(), _matrix(batch.column("signature"))
            for k in range(1, min(bucket, len(path))):
                at = np.flatnonzero(path[k:] == path[:-k])
                if not len(at):
                    break
                at = at[(own[at] == own[at + k]).mean(axis=1) >= least]
                a.append(node[at])
                b.append(node[at + k])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.select("node", "path", "signature").mapInArrow(run, "a long, b long")


def candidates(sets: DataFrame, threshold: float, recall: float, bucket: int, depth: int) -> DataFrame:
    """Edges (a, b) that join candidates; ``sets``: node, signature."""
    paths = _first_level(sets, runs_for(recall, depth), threshold)
    edges: list[DataFrame] = []
    for level in range(1, depth + 1):
        paths = materialise(paths)
        counts = materialise(paths.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("low")).where("n > 1"))
        shared = paths.join(counts, "path")
        small = shared.where(F.col("n") <= bucket).join(sets, "node").select("node", "path", "signature")
        small = small.repartition("path").sortWithinPartitions("path")
        edges.append(materialise(_compare_small(small, bucket, threshold - SLACK).distinct()))
        large = shared.where(F.col("n") > bucket)
        if not counts.where(F.col("n") > bucket).head(1):
            break
        if level == depth:
            edges.append(large.where("node > low").select(F.col("low").alias("a"), F.col("node").alias("b")))
        else:
            paths = _next_level(large.select("node", "path").join(sets, "node"), threshold)
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out


def _elements(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a set is sent once by each task, however often its row is repeated
        for batch in batches:
            for rows, w in W.parts(batch, "text"):
                own = []
                for x, node, name in zip(_sets(w, shingle), rows.column("node").to_pylist(), rows.column("name").to_pylist(), strict=True):
                    fits = node not in seen and _name(x) == name
                    seen.add(node)
                    own.append(x.tobytes() if fits else None)
                yield pa.record_batch([rows.column("node"), rows.column("root"), pa.array(own, pa.binary())], names=["node", "root", "elements"])

    return docs.select("node", "root", "name", "text").mapInArrow(run, "node long, root long, elements binary").where("elements IS NOT NULL")


def _linked(own: list[np.ndarray], side: np.ndarray, across: bool, threshold: float) -> np.ndarray:
    """Which sets are similar; ``across``: only sets of different sides, as others are compared in another task."""
    sizes = np.array([len(x) for x in own])
    _, inverse, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    row, keep = np.repeat(np.arange(len(own)), sizes), often[inverse] > 1
    row, col, n = row[keep], (np.cumsum(often > 1) - 1)[inverse[keep]], int((often > 1).sum())
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(own), len(own)), dtype=np.float32)
    for lo in range(0, n, 2048):
        a, b = np.searchsorted(col, [lo, lo + 2048])
        x = np.zeros((len(own), min(2048, n - lo)), dtype=np.float32)
        x[row[a:b], col[a:b] - lo] = 1
        common += x @ x.T
    linked = common * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-3
    np.fill_diagonal(linked, False)
    return linked & (side[:, None] != side[None, :]) if across else linked


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """node, root, links, low for each set of each task; rows come ordered by root, i, j."""

    def group(key: tuple, rows: dict[int, tuple]) -> Iterator[tuple]:
        unique = list(rows.items())
        node = np.array([x[0] for x in unique])
        side = np.array([x[1][0] != key[1] for x in unique])
        linked = _linked([np.frombuffer(x[1][1], dtype=np.uint64) for x in unique], side, key[1] != key[2], threshold)
        low = node.copy()
        while True:
            new = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (new == low).all():
                break
            low = new
        for i, links in enumerate(linked.sum(axis=1)):
            if links:
                yield int(node[i]), key[0], int(links), int(low[i])

    def pack(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["node", "root", "links", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, {}, []
        for batch in batches:
            for root, i, j, node, block, elements in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (root, i, j) != key:
                    if held:
                        out += group(key, held)
                    key, held = (root, i, j), {}
                held[node] = (block, elements)
            if len(out) >= 10_000:
                yield pack(out)
                out = []
        if held:
            out += group(key, held)
        yield pack(out)

    return rows.mapInArrow(run, "node long, root long, links long, low long")


def classes(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, depth: int = DEPTH, block_sets: int = BLOCK_SETS, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """One row per document: doc_id, copy_of (smallest id with the same set), class_id (smallest id of the class), n_links (other sets that its set is similar to)."""
    return _classes(docs, shingle, threshold, recall, bucket, depth, block_sets, block_elements).drop("text_name", "class_text")


def _classes(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, depth: int = DEPTH, block_sets: int = BLOCK_SETS, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    configure(docs.sparkSession)
    described = materialise(_describe(docs, shingle))
    whole = F.col("size") > 0
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_name")
    sets = described.where(whole).groupBy("name").agg(F.min("doc_id").alias("least"), F.min_by("text_name", first).alias("least_text"), F.first("size").alias("size"), F.first("signature").alias("signature"))
    sets = materialise(sets.withColumn("node", F.monotonically_increasing_id()))
    groups = materialise(components(candidates(sets.select("node", "signature"), threshold, recall, bucket, depth)))

    size = groups.join(sets.select("node", "size"), "node").groupBy("root").agg(F.sum("size").alias("elements"), F.count("*").alias("sets"))
    size = materialise(size.select("root", F.greatest(F.ceil(F.col("elements") / block_elements), F.ceil(F.col("sets") / block_sets)).cast("int").alias("blocks")))
    wanted = materialise(groups.join(sets.select("node", "least", "least_text", "name"), "node"))
    own = maybe_broadcast(wanted.select("node", "root", "name", "least", "least_text"))
    texts = docs.select(F.col("doc_id").alias("own_id"), F.md5("text").alias("own_text"), "text")
    texts = texts.join(own, texts["own_id"].eqNullSafe(own["least"]) & (texts["own_text"] == own["least_text"]))
    cut = _elements(texts, shingle).join(maybe_broadcast(size), "root")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cut = cut.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "elements")
    cut = cut.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    verified = materialise(_verify(cut, threshold))

    # Groups of one block are settled in their task; the parts of larger ones are put together.
    several = maybe_broadcast(size.where("blocks > 1").select("root"))
    pieces = verified.join(several, "root").select(F.col("low").alias("a"), F.col("node").alias("b"))
    settled = verified.join(several, "root", "left_anti").select("node", F.col("low").alias("class_id"))
    if size.where("blocks > 1").head(1):
        settled = settled.unionByName(components(pieces).select("node", F.col("root").alias("class_id")))
    links = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    found = settled.groupBy("node").agg(F.min("class_id").alias("class")).join(links, "node")
    found = materialise(found.join(wanted.select("node", "least", "least_text"), "node"))
    named = found.groupBy("class").agg(F.min("least").alias("class_id"), F.min_by("least_text", F.struct(F.col("least").isNull(), "least", "least_text")).alias("class_text"))
    found = materialise(found.join(named, "class").select("node", "class_id", "class_text", "n_links"))

    alone = F.col("n_links").isNull()  # a set without a link is a class of its own
    members = described.where(whole).select("doc_id", "text_name", "name").join(sets.select("name", "node", "least", "least_text"), "name").join(maybe_broadcast(found), "node", "left")
    own = lambda a, b: F.when(alone, F.col(a)).otherwise(F.col(b))
    members = members.select("doc_id", "text_name", F.col("least").alias("copy_of"), own("least", "class_id").alias("class_id"), own("least_text", "class_text").alias("class_text"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    empty = described.where(~whole).select("doc_id", "text_name", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.col("text_name").alias("class_text"), F.lit(0).cast("long").alias("n_links"))
    return members.unionByName(empty)


def representatives(docs: DataFrame, **how) -> DataFrame:
    """One text of each class, that of the smallest id, with the columns of ``docs``; rows that share id and text stay together."""
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("text_name").eqNullSafe(F.col("class_text"))
    gone = materialise(_classes(docs, **how).where(~stays).select(F.col("doc_id").alias("gone_id"), F.col("text_name").alias("gone_text")).distinct())
    gone = maybe_broadcast(gone)
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.md5(docs["text"]) == gone["gone_text"])
    return docs.join(gone, same, "left_anti").select(docs.columns)
