"""Ranked lexical search: the best documents for each item, by branch and bound over a hierarchical max tree.

Terms follow ``words.py``.  A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), its impact on a document
(10**9 * tf) div (1000 * tf + 12 * m), with m = 75 + (25 * n * N) div L; a document's score for an item sums weight times
impact over the item's terms, repeats included.  N, L and df are counted over all documents.

Items are taken in blocks of a bounded number of terms, so what is sent to the executors has a fixed bound; each block is one
pass over the texts.  That pass writes, for each document, which of the block's terms it has and how often; the bytes of a
term are compared, so a shared hash is no match.  The counts are sums over the written table.

The search runs where that table's parts are.  A part is read in ranges of ``RANGE`` documents; for each term a tree holds
the greatest impact in runs of ``LEAF`` documents, of ``FAN`` such runs, and so on up to the range.  A node's bound for an item is the sum
of its weights times these maxima.  Nodes are opened highest bound first; a leaf's documents are scored exactly.  The search
of a range ends once the highest bound is below the item's last kept score: a node of that very score is opened, as its
documents may have smaller ids.  Kept scores go on from range to range, so later ranges are cut earlier.  The
parts' best documents are merged in two steps, so no task gets more than ``top`` rows from each of a bounded number of groups.

Null texts and items have no terms.  A document without any term isn't counted in N; an item without any gets no rows.
Repeated documents are ranked each, next to each other; a null id comes first among equal scores.  Repeated items count once; items that share an
id but not the text are ranked each.  Empty tables: no rows.  Extra columns are ignored; ids of any type are kept.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import configure
from . import words as W
from .store import materialise

TOP, BLOCK_TERMS = 20, 200_000
#: Documents in a range, in a leaf, and children of a node: powers of two.  A tree has at most ``GROUP_TERMS`` terms.
RANGE, LEAF, FAN, GROUP_TERMS = 8_192, 32, 16, 4_096


class Terms:
    """Distinct terms, found again in texts by hash and then by their bytes."""

    def __init__(self, terms: list[bytes]):
        split = W.split(pa.array([t.decode() for t in terms], pa.string()))
        order = np.argsort(split.hashes, kind="stable")
        self.hashes, self.terms = split.hashes[order], [terms[i] for i in order]
        self.sizes = np.array([len(t) for t in self.terms], dtype=np.int64)
        self.heads = _eight(split.data, split.starts, split.ends)[order] if len(order) else np.zeros(0, np.uint64)
        self.tails = _eight(split.data, np.maximum(split.starts, split.ends - 8), split.ends)[order] if len(order) else np.zeros(0, np.uint64)
        # Terms of one hash stand side by side.
        self.most = int(np.unique(self.hashes, return_counts=True)[1].max()) if len(order) else 0

    def find(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that are terms, and which."""
        if not len(self.hashes) or not len(w.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.searchsorted(self.hashes, w.hashes)
        places, found = [], []
        for k in range(self.most):
            at = np.minimum(first + k, len(self.hashes) - 1)
            here = np.flatnonzero(self.hashes[at] == w.hashes)
            at, start, end = at[here], w.starts[here], w.ends[here]
            same = (self.sizes[at] == end - start) & (self.heads[at] == _eight(w.data, start, end)) & (self.tails[at] == _eight(w.data, np.maximum(start, end - 8), end))
            for i in np.flatnonzero(same & (self.sizes[at] > 16)):
                same[i] = w.data[start[i] : end[i]].tobytes() == self.terms[at[i]]
            places.append(here[same])
            found.append(at[same])
        return np.concatenate(places), np.concatenate(found)


def _eight(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as a number; shorter words end in zeros."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    every = np.lib.stride_tricks.sliding_window_view(padded, 8)
    own = np.ascontiguousarray(every[starts]).view("<u8")[:, 0]
    spare = np.maximum(0, 8 - (ends - starts)).astype(np.uint64) * np.uint64(8)
    return np.where(spare == 64, np.uint64(0), own << np.minimum(spare, np.uint64(63))) if len(own) else own.astype(np.uint64)


def _occurrences(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n, terms, counts of every document: its words, and which of the terms it has how often.  Written."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(sent.value)
        many = max(1, len(known.terms))
        for batch in batches:
            for rows, w in W.parts(batch, "text"):
                docs = len(w.offsets) - 1
                places, term = known.find(w)
                pair, count = np.unique((np.searchsorted(w.offsets, places, "right") - 1) * many + term, return_counts=True)
                where = np.searchsorted(pair // many, np.arange(docs + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(where), pa.array(x, kind)) for x, kind in (((pair % many).astype(np.int32), pa.int32()), (count, pa.int64()))]
                yield pa.record_batch([rows.column("doc_id"), pa.array(w.counts(), pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return materialise(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, counts array<long>"))


class MaxTree:
    """The greatest impact of each term in runs of documents: ``levels[0]`` by leaf, the last one the whole range."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int, docs: int):
        leaves = 1
        while leaves * LEAF < docs:
            leaves *= FAN
        key = doc // LEAF * terms + term
        order = np.argsort(key, kind="stable")
        keys, first = np.unique(key[order], return_index=True)
        level = np.zeros(leaves * terms, dtype=np.int64)
        if len(keys):
            level[keys] = np.maximum.reduceat(impact[order], first)
        self.levels = [level.reshape(leaves, terms)]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, FAN, terms).max(axis=1))
        self.term, self.impact, self.docs = term, impact, docs
        self.offsets = np.searchsorted(doc, np.arange(docs + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list, ids: list, top: int) -> int:
        """Put the range's best documents into ``best`` (sorted: negative score, id); the number of leaves opened."""
        full = np.zeros(self.levels[0].shape[1], dtype=np.int64)
        full[terms] = weights
        height = len(self.levels) - 1
        nodes = [(-int(self.levels[height][0, terms] @ weights), height, 0)]
        opened = 0
        while nodes:
            bound, level, node = heapq.heappop(nodes)
            # Of an equal bound the documents may come first by their ids.
            if not bound or (len(best) == top and bound > best[-1][0]):
                break
            if level:
                lo = node * FAN
                bounds = self.levels[level - 1][lo : lo + FAN][:, terms] @ weights
                for k in np.flatnonzero(bounds).tolist():
                    heapq.heappush(nodes, (-int(bounds[k]), level - 1, lo + k))
                continue
            opened += 1
            lo, hi = node * LEAF, min(self.docs, (node + 1) * LEAF)
            a, b = self.offsets[lo], self.offsets[hi]
            run = np.concatenate([[0], np.cumsum(full[self.term[a:b]] * self.impact[a:b])])
            scores = run[self.offsets[lo + 1 : hi + 1] - a] - run[self.offsets[lo:hi] - a]
            least = -best[-1][0] if len(best) == top else 1
            for k in np.flatnonzero(scores >= least).tolist():
                own = ids[lo + k]
                bisect.insort(best, (-int(scores[k]), own is not None, own if own is not None else 0))
                del best[top:]
        return opened


def _search(found: DataFrame, items: list[tuple[int, dict[int, int]]], weights: np.ndarray, documents: int, words: int, top: int) -> DataFrame:
    """item (its number), doc_id, score: the best of each part of the written table."""
    groups = _groups(items)
    sent = found.sparkSession.sparkContext.broadcast((groups, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, weights = sent.value
        best: dict[int, list] = {item: [] for _, members in groups for item, _, _ in members}
        for rows in _ranges(batches):
            ids = rows.column("doc_id").to_pylist()
            m = 75 + np.array([25 * n * documents // words for n in rows.column("n").to_pylist()], dtype=np.int64)
            lists = rows.column("terms").combine_chunks()
            doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
            term, tf = lists.flatten().to_numpy(), rows.column("counts").combine_chunks().flatten().to_numpy()
            impact = 10**9 * tf // (1000 * tf + 12 * m[doc])
            for terms, members in groups:
                at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                own = terms[at] == term
                _trees(doc[own], at[own], impact[own], ids, terms, members, weights, best, top)
        out = [(item, -score, own if there else None) for item, rows in best.items() for score, there, own in rows]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[2], kind), pa.array(columns[1], pa.int64())], names=["item", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(found.schema["doc_id"].dataType)
    out = found.where(F.size("terms") > 0).mapInArrow(run, f"item long, doc_id {found.schema['doc_id'].dataType.simpleString()}, score long")
    return _best(out, top)


def _trees(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: list, terms: np.ndarray, members: list, weights: np.ndarray, best: dict, top: int) -> None:
    """Search a range for the members of a group.  A group of one item with very many terms gets trees of shorter ranges."""
    step = max(LEAF, RANGE * GROUP_TERMS // max(GROUP_TERMS, len(terms)))
    for lo in range(0, len(ids), step):
        a, b = np.searchsorted(doc, [lo, lo + step])
        if a < b:
            tree = MaxTree(doc[a:b] - lo, term[a:b], impact[a:b], len(terms), min(step, len(ids) - lo))
            for item, own, times in members:
                tree.search(own, weights[terms[own]] * times, best[item], ids[lo : lo + step], top)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= RANGE:
            whole = pa.Table.from_batches(waiting)
            for lo in range(0, rows - RANGE + 1, RANGE):
                yield whole.slice(lo, RANGE)
            waiting = whole.slice(rows - rows % RANGE).to_batches()
            rows %= RANGE
    if rows:
        yield pa.Table.from_batches(waiting)


def _groups(items: list[tuple[int, dict[int, int]]]) -> list[tuple[np.ndarray, list]]:
    """Items in groups of at most ``GROUP_TERMS`` terms (or one item): the group's terms, and for each item their places and repeats."""
    out, own, members = [], set(), []

    def close() -> None:
        if members:
            terms = np.array(sorted(own), dtype=np.int64)
            out.append((terms, [(item, np.searchsorted(terms, list(times)), np.array(list(times.values()), dtype=np.int64)) for item, times in members]))

    for item, times in items:
        if members and len(own.union(times)) > GROUP_TERMS:
            close()
            own, members = set(), []
        own = own.union(times)
        members.append((item, times))
    close()
    return out


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The best ``top`` rows of each item: first within groups of parts, then over these."""
    lanes = max(1, math.isqrt(rows.sparkSession.sparkContext.defaultParallelism)) * 8
    order = (F.desc("score"), F.asc("doc_id"))
    rows = materialise(rows.withColumn("lane", F.spark_partition_id() % lanes))
    near = rows.withColumn("near", F.row_number().over(Window.partitionBy("item", "lane").orderBy(*order))).where(F.col("near") <= top)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def _cut(items: DataFrame) -> DataFrame:
    """item_id, text (its terms, lower case, parted by spaces) and how many, of items that have any; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in W.parts(batch, "text"):
                text = [b" ".join(w.data[w.starts[i] : w.ends[i]].tobytes() for i in range(lo, hi)) for lo, hi in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
                yield pa.record_batch([rows.column("item_id"), pa.array(text, pa.binary()).cast(pa.string()), pa.array(w.counts(), pa.int64())], names=["item_id", "text", "n"])

    own_id = items.schema["item_id"].dataType.simpleString()
    return materialise(items.select("item_id", "text").distinct().mapInArrow(run, f"item_id {own_id}, text string, n long").where("n > 0").withColumn("h", F.xxhash64("text")))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` highest-scoring documents of each item with a score above 0."""
    configure(docs.sparkSession)
    spark = docs.sparkSession
    cut = _cut(items)
    blocks = max(1, -(-(cut.agg(F.sum("n")).first()[0] or 0) // block_terms))
    out = None
    for k in range(blocks):
        # A block of about ``block_terms`` terms; a longer item is a block of its own length.
        rows = cut.where(F.pmod("h", F.lit(blocks)) == k).select("item_id", "text").collect()
        own = [t.text.encode().split() for t in rows]
        known = Terms(sorted({t for x in own for t in x}))
        number = {t: i for i, t in enumerate(known.terms)}
        found = _occurrences(docs, known.terms)
        total = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        holds = dict(found.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow().to_pandas().itertuples(index=False, name=None))  # at most the block's terms
        weights = np.array([math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * holds.get(i, 0) + 1))) for i in range(len(number))], dtype=np.int64)
        times = []
        for item, terms in enumerate(own):
            count: dict[int, int] = {}
            for t in terms:
                count[number[t]] = count.get(number[t], 0) + 1
            times.append((item, count))
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        ranked = _search(found, times, weights, total["documents"], total["words"], top).join(F.broadcast(names), "item")  # a block's items
        ranked = materialise(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
        out = ranked if out is None else out.unionByName(ranked)
    return out


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE text IS NOT NULL
), s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0
), tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY doc_id, t
), wt AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM tf, s GROUP BY t, n_docs
), m AS (SELECT doc_id, 75 + (25 * len(w) * n_docs) // l AS m FROM d, s WHERE len(w) > 0
), p AS (SELECT b.item_id, tf.doc_id, CAST(sum(wt.wt * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m))) AS BIGINT) AS score FROM b JOIN tf ON b.t = tf.t JOIN wt ON b.t = wt.t JOIN m ON tf.doc_id = m.doc_id GROUP BY b.item_id, tf.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0) WHERE rank <= 20
"""
