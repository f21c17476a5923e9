"""Benchmark passages in documents, by a prefix-filtered set join.

Words follow ``words.py``.  An item's windows are its runs of ``window`` consecutive words; an item of
fewer words, but not none, is one window.  Shingles (``shingle`` words, fewer in shorter windows) are ordered
by the number of documents that hold them, counted over all documents.  Containment of a whole window
needs a prefix of one shingle in that order, its rarest; documents are probed for these alone.  A hit gives
the place where the window would have to begin; length and place are bounded by the document's words, then the
window is compared there, first by identity, then byte for byte.

Items are cut into windows first, and distinct windows are searched in blocks of about ``block_windows``, so what is
sent to the executors has a fixed bound however long or many items are; each block is two more passes over the
documents, and its hits are written before the next one is sent.  Documents never move.

Null texts have no words.  Items without words match nothing; those without an id are the item ''.  Empty tables: no
hits.  Repeated items count once.  Each row is judged by its own text: repeated documents, and documents that share an
id, give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import configure
from . import words as W
from .store import id_type, materialise, maybe_broadcast

WINDOW, SHINGLE, BLOCK_WINDOWS = 10, 3, 200_000


def _cut(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, text: the distinct windows of each item, their words joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in W.parts(batch, "text"):
                for row, (lo, hi) in enumerate(zip(w.offsets[:-1], w.offsets[1:], strict=True)):
                    n = min(window, hi - lo)
                    for first in range(lo, hi - n + 1 if n else lo, 10_000):
                        own = [b" ".join(w.data[w.starts[i] : w.ends[i]].tobytes() for i in range(at, at + n)) for at in range(first, min(first + 10_000, hi - n + 1))]
                        yield pa.record_batch([pa.array([rows.column("item_id")[row].as_py()] * len(own), pa.string()), pa.array(own, pa.binary()).cast(pa.string())], names=["item_id", "text"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text IS NOT NULL").distinct()
    return items.mapInArrow(run, "item_id string, text string").distinct()


def _windows(block: pa.Table, shingle: int) -> dict[int, dict[str, np.ndarray | list]]:
    """By length of the window: its words' hashes and text, its item (as a row number), its identity."""
    w = W.split(block.column("text"))
    counts, out = w.counts(), {}
    for n in np.unique(counts).tolist():
        rows, size = np.flatnonzero(counts == n), min(shingle, n)
        hashes = w.hashes[w.offsets[rows][:, None] + np.arange(n)]
        flat = W.Words(hashes.ravel(), np.zeros(0), np.zeros(0), np.arange(len(rows) + 1) * n, np.zeros(0))
        text = [block.column("text")[int(i)].as_py().encode() for i in rows]
        out[n] = {"text": text, "item": rows, "size": size, "id": flat.shingles(n)[0][::n], "shingles": flat.shingles(size)[0].reshape(-1, n)[:, : n - size + 1]}
    return out


def _index(windows: dict[int, dict], frequency: dict[int, int]) -> dict[int, dict]:
    """Windows of each length, ordered by their rarest shingle."""
    for own in windows.values():
        often = np.vectorize(lambda x: frequency.get(int(x), 0), otypes=[np.int64])(own["shingles"])
        own["at"] = np.lexsort((own["shingles"], often), axis=1)[:, 0]
        own["prefix"] = own["shingles"][np.arange(len(own["at"])), own["at"]]
        order = np.argsort(own["prefix"], kind="stable")
        for k in ("id", "item", "at", "prefix"):
            own[k] = own[k][order]
        own["text"] = [own["text"][i] for i in order]
        del own["shingles"]
    return windows


def _frequency(docs: DataFrame, sizes: dict[int, np.ndarray]) -> dict[int, int]:
    """In how many documents each of the items' shingles occurs; bounded by the block's shingles."""
    sent = docs.sparkSession.sparkContext.broadcast(sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(v), dtype=np.int64) for k, v in sent.value.items()}
        for batch in batches:
            for _, w in W.parts(batch, "text"):
                doc = np.repeat(np.arange(len(w.offsets) - 1), w.counts())
                for k, wanted in sent.value.items():
                    ids, valid = w.shingles(k)
                    at = np.minimum(np.searchsorted(wanted, ids), len(wanted) - 1)
                    found = valid & (wanted[at] == ids)
                    pairs = np.unique(doc[found] * np.int64(len(wanted)) + at[found])
                    total[k] += np.bincount(pairs % len(wanted), minlength=len(wanted))
        for k, n in total.items():
            hit = np.flatnonzero(n)
            yield pa.record_batch({"size": pa.array(np.full(len(hit), k), pa.int32()), "shingle": pa.array(sent.value[k][hit].view(np.int64)), "n": pa.array(n[hit])})

    found = docs.select("text").mapInArrow(count, "size int, shingle long, n long").groupBy("size", "shingle").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    return {x % 2**64: n for x, n in zip(found["shingle"].to_pylist(), found["n"].to_pylist(), strict=True)}


_HITS = "name string, n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def _probe(docs: DataFrame, index: dict[int, dict], names: list[str], all_rows: bool) -> DataFrame:
    """The documents with what is found in them, written; without ``all_rows`` only those with a hit."""
    sent = docs.sparkSession.sparkContext.broadcast((index, names))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = sent.value
        for batch in batches:
            for rows, w in W.parts(batch, "text"):
                n = len(w.offsets) - 1
                spans: list[list] = [[] for _ in range(n)]
                items: list[set] = [set() for _ in range(n)]
                doc = np.repeat(np.arange(n), w.counts())
                for length, own in index.items():
                    ids, valid = w.shingles(own["size"])
                    lo = np.searchsorted(own["prefix"], ids, "left")
                    hi = np.searchsorted(own["prefix"], ids, "right")
                    places = np.flatnonzero(valid & (hi > lo))
                    if not len(places):
                        continue
                    each = (hi - lo)[places]
                    window = np.repeat(lo[places], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    begin = np.repeat(places, each) - own["at"][window]
                    d = np.repeat(doc[places], each)
                    whole, fits = w.shingles(length)
                    inside = (begin >= w.offsets[d]) & (begin + length <= w.offsets[d + 1])
                    window, begin, d = window[inside], begin[inside], d[inside]
                    same = fits[begin] & (whole[begin] == own["id"][window])
                    for k, at, x in zip(window[same], begin[same], d[same], strict=True):
                        if b" ".join(w.data[w.starts[i] : w.ends[i]].tobytes() for i in range(at, at + length)) == own["text"][k]:
                            at -= w.offsets[x]
                            spans[x].append((at, at + length))
                            items[x].add(names[own["item"][k]])
                merged = []
                for own_spans in spans:
                    out: list[dict] = []
                    for a, b in sorted(set(own_spans)):
                        if out and a <= out[-1]["last"]:
                            out[-1]["last"] = max(out[-1]["last"], int(b))
                        else:
                            out.append({"first": int(a), "last": int(b)})
                    merged.append(out)
                yield pa.record_batch(
                    [rows.column("doc_id"), rows.column("name"), pa.array(w.counts(), pa.int64()), pa.array(merged, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=["doc_id", "name", "n_words", "spans", "items"],
                )

    found = docs.select("doc_id", _name(docs).alias("name"), "text").mapInArrow(probe, f"doc_id {id_type(docs)}, {_HITS}")
    out = materialise(found if all_rows else found.where("size(spans) > 0"))
    sent.destroy()
    return out


def _name(docs: DataFrame) -> Column:
    """128 bits of the text: with the id it tells rows apart, as what a row holds depends on its text alone."""
    return F.md5(F.coalesce(docs["text"], F.lit("")))


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (word ranges inside windows, merged), items (ids as strings)."""
    return _overlaps(docs, benchmark, window, shingle, block_windows).drop("name")


def _overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    configure(docs.sparkSession)
    names_of: list[DataFrame] = []
    for block in _blocks(benchmark, window, block_windows):
        windows = _windows(block, shingle)
        sizes: dict[int, list] = {}
        for own in windows.values():
            sizes.setdefault(own["size"], []).append(own["shingles"].ravel())
        wanted = {k: np.unique(np.concatenate(v)) for k, v in sizes.items()}
        frequency = _frequency(docs, wanted) if wanted else {}
        names_of.append(_probe(docs, _index(windows, frequency), block.column("item_id").to_pylist(), not names_of))
    if len(names_of) == 1:
        return names_of[0]
    # More blocks: one row per document and block, put together by a key that is the same for the same text only.
    key = F.struct("doc_id", "name")
    out = names_of[0].where("size(spans) > 0")
    for more in names_of[1:]:
        out = out.unionByName(more)
    out = out.distinct()
    hits = out.groupBy(key.alias("key")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = materialise(hits)
    base = names_of[0].select("doc_id", "name", "n_words", key.alias("key"))
    empty = "array<struct<first:bigint,last:bigint>>"
    merged = F.aggregate(
        "spans",
        F.array().cast(empty),
        lambda done, x: F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= x["first"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.try_element_at(done, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(done, F.lit(-1))["last"], x["last"]).alias("last"))))).otherwise(F.concat(done, F.array(x))),
    )
    joined = base.join(maybe_broadcast(hits), "key", "left")
    return joined.select("doc_id", "name", "n_words", F.coalesce(merged, F.array().cast(empty)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _blocks(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[pa.Table]:
    """The items' windows in tables of about ``block_windows`` rows; one empty table if there are none."""
    cut = materialise(_cut(benchmark, window))
    total = cut.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    # Words may be long: a block is bounded in bytes as well.
    n = max(1, -(-total["rows"] // block_windows), -(-total["bytes"] // (block_windows * 256)))
    for k in range(n):
        yield cut.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow().combine_chunks()


def digest(found: DataFrame) -> DataFrame:
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents in which no window occurs, with the columns of ``docs``; each row is judged by its own text."""
    hit = materialise(_overlaps(docs, benchmark, **how).where("size(spans) > 0").select(F.col("doc_id").alias("hit_id"), F.col("name").alias("hit_name")).distinct())
    hit = maybe_broadcast(hit)
    same = docs["doc_id"].eqNullSafe(hit["hit_id"]) & (_name(docs) == hit["hit_name"])
    return docs.join(hit, same, "left_anti").select(docs.columns)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM iw), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), h AS (SELECT dw.doc_id, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
