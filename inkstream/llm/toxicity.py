"""Toxic text by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings (4, 5 and 8 bytes) is trained in numpy from
confirmed toxic documents and unlabelled ones.  With class prior p, the risk is
``p * mean_P loss(+) + max(0, mean_U loss(-) - p * mean_P loss(-))``; where the bracket turns negative, the step
goes back along its gradient.  The prior is the share of toxic rows among the labels that may be learnt
from.  Training sees at most ``positives`` and ``unlabelled`` documents, picked by a hash of the id, of a repeated id one
text, and of each at most ``MOST_FEATURES`` features, picked by their hash from the whole text; scoring
reads every whole text, in one pass and without a shuffle.

Null or empty texts get the score of a text without features.  Without a confirmed toxic example all scores
are 0.  Repeated rows are scored each; repeated labels count once.  Null labels and ids are not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import configure
from . import words as W
from .store import id_type

BITS = 22
THRESHOLD = 0.7
POSITIVES, UNLABELLED, MOST_FEATURES = 3_000, 9_000, 50_000
#: A feature is used if it is commoner in toxic documents, at odds of e to this power against chance (a bound on
#: the Poisson tail), and in at least this many of them.
ODDS, LEAST = 10, 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _features(w: W.Words) -> list[np.ndarray]:
    """For each word its features' numbers: the word, and its first 4, 5 and 8 bytes."""
    return [(h >> np.uint64(64 - BITS)).astype(np.int64) for h in (w.hashes, w.prefix(4), w.prefix(5), w.prefix(8))]


@dataclass
class Model:
    """numbers (ascending) and weights of the features used; the bias; the class prior (0: untrained)."""

    numbers: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def __post_init__(self):
        # Most features of a text aren't used; their low bits tell, in a table that fits the cache.
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[self.numbers & 0xFFFF] = True

    def scores(self, w: W.Words) -> np.ndarray:
        n = len(w.offsets) - 1
        if self.prior <= 0:
            return np.zeros(n)
        z = np.full(n, self.bias)
        if len(self.numbers):
            pairs = []
            for f in _features(w):
                at = np.flatnonzero(self.seen[f & 0xFFFF])
                place = np.minimum(np.searchsorted(self.numbers, f[at]), len(self.numbers) - 1)
                hit = self.numbers[place] == f[at]
                doc = np.searchsorted(w.offsets, at[hit], "right") - 1
                pairs.append(doc * len(self.numbers) + place[hit])
            found = np.unique(np.concatenate(pairs))
            z += np.bincount(found // len(self.numbers), self.weights[found % len(self.numbers)], n)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _distinct(docs: list[np.ndarray]) -> list[np.ndarray]:
    """Without near copies of earlier documents: their words would count as often as they were copied.

    Four min-hashes of the features are equal in one of three draws.
    """
    rng = np.random.default_rng(11)
    a, b = rng.integers(1, 2**31, 12) * 2 + 1, rng.integers(0, 2**31, 12)
    seen: set[tuple] = set()
    out = []
    for own in docs:
        low = ((own[:, None].astype(np.int64) * a + b) & 0xFFFFFFFF).min(axis=0) if len(own) else a
        keys = {(k, *low[4 * k : 4 * k + 4].tolist()) for k in range(3)}
        if not keys & seen:
            out.append(own)
        seen |= keys
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The corrected risk of these outputs under the logistic loss, and the step's gradient by each output.

    Where the negative part is below 0 it counts as 0, and the step undoes it: the gradient is that part's, turned.
    """
    s_p, s_u = _sigmoid(z_p), _sigmoid(z_u)
    minus = float(np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean())
    value = float(prior * np.logaddexp(0, -z_p).mean()) + max(0.0, minus)
    # d loss(+) = s - 1, d loss(-) = s
    down_p, down_u = -prior * s_p / len(z_p), s_u / len(z_u)
    up = prior * (s_p - 1) / len(z_p)
    return (value, up + down_p, down_u) if minus >= 0 else (value, -down_p, -down_u)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 600, l2: float = 1e-5, rate: float = 0.1) -> Model:
    """``positive`` and ``unlabelled``: the distinct feature numbers of each document."""
    positive, unlabelled = _distinct(positive), _distinct(unlabelled)
    if not positive or not unlabelled or prior <= 0:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), 0.0, 0.0)
    n_p, n_u = len(positive), len(unlabelled)

    def counts(docs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.int32)
        for own in docs:
            out[own] += 1
        return out

    p, u = counts(positive), counts(unlabelled)
    used = np.flatnonzero(p >= LEAST)
    p, u = p[used].astype(float), u[used]
    chance = n_p * (u + 1) / n_u  # how often it should be in as many unlabelled documents
    odds = np.where(p > chance, p * np.log(p / chance) - p + chance, 0)
    used = used[odds > ODDS]

    def rows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row, col = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, own in enumerate(docs if len(used) else []):
            at = np.minimum(np.searchsorted(used, own), len(used) - 1)
            at = at[used[at] == own]
            row.append(np.full(len(at), k))
            col.append(at)
        return np.concatenate(row), np.concatenate(col)

    (p_row, p_col), (u_row, u_col) = rows(positive), rows(unlabelled)
    w, b = np.zeros(len(used)), float(np.log(prior / (1 - prior))) if prior < 1 else 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        z_p = b + np.bincount(p_row, w[p_col], n_p)
        z_u = b + np.bincount(u_row, w[u_col], n_u)
        _, d_p, d_u = risk(z_p, z_u, prior)
        grad = np.append(np.bincount(p_col, d_p[p_row], len(used)) + np.bincount(u_col, d_u[u_row], len(used)) + l2 * w, d_p.sum() + d_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(used, w, float(b), prior)


def _bounded(own: np.ndarray, rows: int) -> np.ndarray:
    """Which of the features (by row) are kept: of each row at most ``MOST_FEATURES``."""
    keep = np.ones(len(own), dtype=bool)
    ends = np.searchsorted(own, np.arange(rows + 1) << BITS)
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        if hi - lo > MOST_FEATURES:
            draw = W.mix((own[lo:hi] & ((1 << BITS) - 1)).astype(np.uint64))
            keep[lo:hi] = draw <= np.partition(draw, MOST_FEATURES - 1)[MOST_FEATURES - 1]
    return keep


def _distinct_features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in W.parts(batch, "text"):
                own = np.concatenate([np.zeros(0, np.int64)] + [f + (np.repeat(np.arange(rows.num_rows), w.counts()) << BITS) for f in _features(w)])
                own = np.unique(own)
                own = own[_bounded(own, rows.num_rows)]
                ends = np.searchsorted(own, np.arange(rows.num_rows + 1) << BITS)
                values = pa.array((own & ((1 << BITS) - 1)).astype(np.int32))
                yield pa.record_batch([rows.column("doc_id"), rows.column("positive"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], names=["doc_id", "positive", "features"])

    return docs.select("doc_id", "positive", "text").mapInArrow(run, f"doc_id {id_type(docs)}, positive boolean, features array<int>")


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from rows that are not held out."""
    configure(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.agg(F.count_distinct("doc_id").alias("n"), F.count_distinct(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("toxic")).first()
    if not counts["toxic"]:
        return fit([], [], 0.0)
    spread = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").select("doc_id").distinct().orderBy(spread, "doc_id").limit(positives).withColumn("positive", F.lit(True))
    free = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    chosen = chosen.unionByName(free.orderBy(spread, "doc_id").limit(unlabelled).withColumn("positive", F.lit(False)))
    # At most positives + unlabelled ids, each once, as combined on the map side.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    sample = _distinct_features(rows).toArrow().sort_by("doc_id")  # one order, whatever the tasks'
    is_positive, features = sample.column("positive").to_pylist(), sample.column("features")
    own = [np.asarray(x.values) for x in features.combine_chunks()] if sample.num_rows else []
    return fit([x for x, y in zip(own, is_positive, strict=True) if y], [x for x, y in zip(own, is_positive, strict=True) if not y], counts["toxic"] / counts["n"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    configure(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in W.parts(batch, "text"):
                yield pa.record_batch([rows.column("doc_id"), pa.array(sent.value.scores(w))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, score double")


def scored(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = score(docs, train(docs, labels, **how))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that are not predicted toxic, with the columns of ``docs``, in one pass."""
    model = train(docs, labels, **how)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in W.parts(batch, "text"):
                yield rows.filter(pa.array(sent.value.scores(w) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
