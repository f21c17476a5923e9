"""Vectors as short codes: integer parts, a codebook for each part, and the nearest entry of each.

A component x is the integer floor(``scale`` * x); a vector is cut into ``parts`` equal consecutive parts.  A part's
codebook begins as that part of the ``entries`` smallest ids.  In each of ``rounds`` rounds every part goes to its nearest entry
(squared Euclidean distance, ties to the lower index), and each entry becomes the componentwise floor of its parts' mean; an entry
without parts stays.  Then parts are assigned once more.

Codebooks are broadcast (``parts`` x ``entries`` short rows, whatever the table's size).  A task takes Arrow batches and finds all
distances by norm expansion with exact int64 matrix products; sums and counts of entries are added up inside the task, so
it sends at most ``parts`` x ``entries`` rows, merged by a grouped shuffle.  The driver holds codebooks and their sums only.

Rows whose vector is null or holds null or non-finite components are dropped.  The length that most vectors have (of several
the longest) counts, if it is a multiple of ``parts`` and not 0; a vector of another length is returned without code and error.
Seeds: a null id comes last, equal ids go by vector; fewer vectors make smaller codebooks.  Repeated rows each get a row.
A table without vectors gives no rows.  Components that int64 distances can't hold exactly (for 16 in a part: 2**18
and more) are an error, never a wrong code.  Extra columns are ignored; ids and labels of any type are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import configure
from .store import materialise, maybe_broadcast

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4


def integers(vectors: DataFrame, vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label, ints of the rows that are kept, written."""
    own = F.col(vector)
    kept = own.isNotNull() & ~F.exists(own, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # A power of two times a float or double has no rounding.
    ints = F.transform(own, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return materialise(vectors.where(kept).select("vec_id", F.col(label).alias("label"), ints.alias("ints")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``part`` the first nearest row of ``book`` and its squared distance; exact, as sums wrap around alike."""
    far = (part * part).sum(axis=1)[:, None] - 2 * (part @ book.T) + (book * book).sum(axis=1)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(part)), at]


def _sums(kept: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By part and entry: how many parts it has, and their componentwise sums."""
    spark = kept.sparkSession
    sent = spark.sparkContext.broadcast(books)
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        n, total = np.zeros(parts * entries, dtype=np.int64), np.zeros((parts * entries, width), dtype=np.int64)
        for batch in batches:
            rows = _matrix(batch.column("ints"), parts * width)
            for k in range(parts):
                own = rows[:, k * width : (k + 1) * width]
                at = nearest(own, books[k])[0] + k * entries
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                if len(used):
                    total[used] += np.add.reduceat(own[order], first, axis=0)
                    n += np.bincount(at, minlength=parts * entries)
        used = np.flatnonzero(n)
        yield pa.record_batch({"entry": pa.array(used), "n": pa.array(n[used]), "total": pa.array(list(total[used]), pa.list_(pa.int64()))})

    found = kept.select("ints").mapInArrow(run, "entry long, n long, total array<long>")
    # At most one row per entry comes back.
    merged = found.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[k]) for k in range(width))).alias("total")).toArrow()
    n, total = np.zeros(parts * entries, dtype=np.int64), np.zeros((parts * entries, width), dtype=np.int64)
    at = merged["entry"].to_numpy()
    n[at] = merged["n"].to_numpy()
    if len(at):
        total[at] = _matrix(merged["total"].combine_chunks(), width)
    sent.destroy()
    return n.reshape(parts, entries), total.reshape(parts, entries, width)


def codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) from the integers' table; of no entries if there is no vector that can be cut."""
    lengths = kept.groupBy(F.size("ints").alias("size")).agg(F.count("*").alias("n")).where((F.col("size") > 0) & (F.col("size") % parts == 0))
    size = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    if size is None:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    kept = kept.where(F.size("ints") == size["size"])
    width = size["size"] // parts
    # Distances up to width * (2 * most)**2 fit into 63 bits.
    most = int(((2**63 - 1) // width) ** 0.5) // 2 - 1
    high = kept.agg(F.max(F.greatest(F.array_max("ints"), -F.array_min("ints")))).first()[0]
    if high > most:
        raise ValueError(f"a component is {high}; distances are exact up to {most}")
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").toArrow()
    books = _matrix(seeds["ints"].combine_chunks(), size["size"]).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        n, total = _sums(kept, books)
        books = np.where(n[:, :, None] > 0, total // np.maximum(n, 1)[:, :, None], books)
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error: the nearest entries' indexes in hexadecimal, and the squared distances' sum."""
    parts, entries, width = books.shape
    configure(kept.sparkSession)
    sent = kept.sparkSession.sparkContext.broadcast(books)
    digits = max(2, len(f"{max(entries, 1) - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        for batch in batches:
            fits = np.array([len(x) == parts * width > 0 for x in batch.column("ints")], dtype=bool)
            rows = _matrix(batch.column("ints").filter(pa.array(fits)), parts * width) if fits.any() else np.zeros((0, parts * width), dtype=np.int64)
            at, far = zip(*(nearest(rows[:, k * width : (k + 1) * width], books[k]) for k in range(parts)), strict=True) if len(rows) else ([], [])
            code, error = np.full(len(fits), None, dtype=object), np.zeros(len(fits), dtype=np.int64)
            if len(rows):
                code[fits] = ["".join(f"{x:0{digits}x}" for x in own) for own in np.stack(at, axis=1).tolist()]
                error[fits] = np.sum(far, axis=0)
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, mask=~fits)], names=["vec_id", "label", "code", "error"])

    types = {c: kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return kept.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def digest(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    configure(vectors.sparkSession)
    kept = integers(vectors)
    books = codebooks(kept, parts, entries, rounds)
    coded = materialise(encode(kept, books))
    labels = maybe_broadcast(materialise(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))))
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(labels, coded["label"].eqNullSafe(labels["of_label"])).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    """The same in another engine: parts as lists of whole doubles, a step for each round."""
    steps = []
    for k in range(rounds + 1):
        # Equal distances: the first entry.
        steps.append(f"a{k} AS (SELECT p.r, p.part, p.v, min({{'d': CAST(list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.c) + list_inner_product(b.c, b.c) AS BIGINT), 'e': b.entry}}) AS best FROM p JOIN b{k} b USING (part) GROUP BY p.r, p.part, p.v)")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT part, best.e AS entry, i, floor(sum(v[i]) / count(*)) AS x FROM a{k}, generate_series(1, 16) g(i) GROUP BY ALL)")
            steps.append(f"b{k + 1} AS (SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS c FROM m{k} GROUP BY part, entry) n USING (part, entry))")
    return f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (SELECT r, part, v[16 * part + 1:16 * part + 16] AS v FROM k, generate_series(0, 3) g(part)
), b0 AS (SELECT part, r - 1 AS entry, v AS c FROM p WHERE r <= 256
), {", ".join(steps)}, f AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r
), s AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS x, unnest(range(len(c))) AS i FROM b{rounds}))
SELECT k.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, s.codebooks_sha256 FROM k JOIN f ON k.r = f.r, s
"""


#: For vectors of 64 components, as the test tables have.
SQL = _sql()
