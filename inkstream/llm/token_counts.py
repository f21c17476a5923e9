"""Token counts from the exact histogram of encoded lengths.

Every whole text is encoded with a public byte-level vocabulary (its file is a parameter); the histogram keeps,
for each length, how many documents have it.  Suffix sums over it answer, for every context limit: how many
documents are as long, their tokens, and the total if every document were cut at the limit.  ``answers`` looks limits and
quantiles up in the suffix sums: a limit's are those of the next length that occurs, so no document is counted again.

Documents are aggregated by length on the map side, so the shuffle is as small as the histogram.  Suffix sums are
taken in two levels (ranges of ``RANGE`` lengths, then inside them), so no task sees the whole histogram.

Null and empty texts have length 0.  Repeated rows count each.  An empty table has an empty histogram.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator, Sequence
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import configure
from .store import materialise, maybe_broadcast

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level vocabularies of this kind part text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANGE = 512
#: Context limits and quantiles of the registered query.
LIMITS, QUANTILES = tuple(2**k for k in range(7, 21)), (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


@lru_cache(maxsize=2)
def _encoder(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every row."""
    configure(docs.sparkSession)
    with open(vocabulary, "rb") as file:  # read by the driver alone; executors get its content
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(sent.value).encode_to_numpy
        for batch in batches:
            n = [len(encode(text, disallowed_special=())) if text else 0 for text in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.array(n, dtype=np.int64))], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """By length: n_docs, docs_at_least, tokens_at_least, tokens_if_cut (all documents cut at this length)."""
    lengths = materialise(counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))
    lengths = lengths.withColumn("part", F.floor(F.col("n_tokens") / RANGE)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    parts = lengths.groupBy("part").agg(F.sum("n_docs").alias("docs_here"), F.sum("tokens").alias("tokens_here"))
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *(F.coalesce(F.sum(f"{c}_here").over(later), F.lit(0)).alias(f"{c}_later") for c in ("docs", "tokens")))
    total = lengths.agg(F.sum("tokens")).first()[0] or 0
    from_here = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = lengths.join(maybe_broadcast(parts), "part")
    docs_at_least = F.sum("n_docs").over(from_here) + F.col("docs_later")
    tokens_at_least = F.sum("tokens").over(from_here) + F.col("tokens_later")
    out = out.select("n_tokens", "n_docs", docs_at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"))
    return out.withColumn("tokens_if_cut", F.lit(total) - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens"))


def answers(hist: DataFrame, limits: Sequence[int] = LIMITS, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """A row for each limit (kind 'limit', n_tokens its length) and each q (kind 'quantile', n_tokens the smallest length with that share of documents at or below it).

    The suffix sums are those at that length: n_docs of exactly that length, docs_at_least, tokens_at_least, tokens_if_cut.
    """
    # The shortest length's suffix sums are the totals.
    row = F.struct("n_tokens", "n_docs", "docs_at_least", "tokens_at_least")
    all_docs, all_tokens = ((x := hist.agg(F.min(row).alias("x")).first()["x"]) and (x["docs_at_least"], x["tokens_at_least"])) or (0, 0)
    shorter = F.lit(all_docs) - F.col("docs_at_least") + F.col("n_docs")
    asked = [F.min(F.when(F.col("n_tokens") >= int(x), row)) for x in limits]
    asked += [F.min(F.when(shorter >= math.ceil(Fraction(str(q)) * all_docs), row)) for q in quantiles]
    found = hist.agg(*(c.alias(f"c{k}") for k, c in enumerate(asked))).first() if asked else []
    out = []
    for k, at in enumerate([*limits, *quantiles]):
        x, is_limit = found[k], k < len(limits)
        n = int(at) if is_limit else x["n_tokens"] if x else None
        least, tokens = (x["docs_at_least"], x["tokens_at_least"]) if x else (0, 0)
        own = x["n_docs"] if x and x["n_tokens"] == n else 0
        out.append(("limit" if is_limit else "quantile", None if is_limit else float(at), n, own, least, tokens, None if n is None else all_tokens - tokens + least * n))
    return hist.sparkSession.createDataFrame(out, "kind string, q double, n_tokens long, n_docs long, docs_at_least long, tokens_at_least long, tokens_if_cut long")


def report(hist: DataFrame, limits: Sequence[int] = LIMITS, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """The histogram (kind 'length') and the answers."""
    hist = materialise(hist)
    lengths = hist.select(F.lit("length").alias("kind"), F.lit(None).cast("double").alias("q"), "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "tokens_if_cut")
    return lengths.unionByName(answers(hist, limits, quantiles))
