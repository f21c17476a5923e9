"""Documents packed into sequences of a fixed number of tokens, by best-fit decreasing.

A document is its whole text's token ids and an end id.  One of more than ``most`` tokens is cut into pieces of ``most``;
its first piece takes what is over.  Pieces go longest first, each to the open sequence with the least room that still
holds it; a segment tree over the rooms finds that sequence in logarithmic time.

The packing depends on how many pieces have each length, and pieces of one length are alike.  So the driver gets a
histogram of at most ``most`` lengths, and the tree is asked once for a run of equal pieces: the tightest sequence
takes pieces of that length until no more fit, as it stays the tightest.  Alike sequences are kept as one class of consecutive
numbers.  A length splits at most two classes and opens two, and a class at least halves its room whenever it is
filled, so the plan has at most some 40 entries a length, however many documents there are.  It is the exact packing of all pieces.

Spark numbers the pieces of a length: each task numbers its own while it encodes and the numbers are written; sums
over tasks come before them.  A piece's place follows from its number by arithmetic.  No group of equal lengths is gathered.

Ids are those of the ``tokenizers`` library.  Its own splitting into pre-tokens is slow, so words are cut by the same
pattern here, with the kinds of characters (letter, digit, space) asked from the library before their first use, and each distinct
word is encoded once by the library's model.  A text with the string of an added token goes to the library whole.

Null and empty texts are the end id alone.  Repeated rows are packed each; a null id stays null.  An empty table gives no
rows.  Extra columns are ignored.  Ids of any type are kept.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import configure
from .store import id_type, materialise, maybe_broadcast

MOST, END = 1024, 2
_CACHED = 250_000


class _Known(dict):
    """Ids of words.  What wasn't used since the last change of generations goes at the next one, so memory is bounded."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHED:
            self.old = dict(self)
            self.clear()
        out = self[word] = self.old.get(word) or self.encode(word)
        return out


class _Encoder:
    """Token ids of a text as the bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(vocabulary)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # How byte-level models write a byte: as the Latin-1 character if that is visible, else as the next one from U+0100 on.
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = dict(zip([*seen, *sorted(set(range(256)).difference(seen))], [*seen, *range(0x100, 0x144)], strict=True))
        tokenize = self.whole.model.tokenize

        def one(word: str) -> bytes:
            ids = [t.id for t in tokenize(word.encode().decode("latin-1").translate(shown))]
            return struct.pack(f"<{len(ids)}I", *ids)

        self.known, self.ranges, self.tried = _Known(one), {"letter": [], "digit": [], "other": [], "space": []}, set()
        self._learn(set(map(chr, range(0x250))))

    def _learn(self, characters: set[str]) -> None:
        """The kind of each character of these blocks of 256, as the library parts it from one of a known kind; the pattern with these kinds."""
        split = self.whole.pre_tokenizer.pre_tokenize_str
        for block in sorted({ord(c) >> 8 for c in characters}):
            for c in map(chr, range(block << 8, (block + 1) << 8)):
                kind = next((k for k, known in (("letter", "a"), ("digit", "1"), ("other", "!")) if len(split(known + c)) == 1), "space")
                own = self.ranges[kind]
                if own and ord(own[-1][1]) + 1 == ord(c):
                    own[-1] = (own[-1][0], c)
                else:
                    own.append((c, c))
                self.tried.add(c)
        letter, digit, space = ("".join(f"{re.escape(a)}-{re.escape(b)}" for a, b in self.ranges[k]) for k in ("letter", "digit", "space"))
        # Fixed: how byte-level vocabularies of this kind part text before merging.
        self.words = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+").findall

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if new := set(text).difference(self.tried):
            self._learn(new)
        return b"".join(map(self.known.__getitem__, self.words(text)))


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> _Encoder:
    return _Encoder(vocabulary)


def pieces(docs: DataFrame, vocabulary: str | None = None, most: int = MOST, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids); lane and no: the task, and the number among its pieces of that length.  Written."""
    spark = docs.sparkSession
    configure(spark)
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    with open(vocabulary, encoding="utf-8") as file:  # read by the driver alone; executors get its content
        sent = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = _encoder(sent.value), end.to_bytes(4, "little")
        seen, lane = np.zeros(most + 1, dtype=np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                own = (encode(text) if text else b"") + last
                n = len(own) // 4
                at, size = 0, (n - 1) % most + 1
                while at < n:
                    part = own[4 * at : 4 * (at + size)]
                    rows.append(row)
                    piece.append((at + most - 1) // most)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                    at, size = at + size, most
            sizes = np.array(length, dtype=np.int64)
            order = np.argsort(sizes, kind="stable")
            first = np.searchsorted(sizes[order], sizes[order])
            no = np.empty(len(sizes), dtype=np.int64)
            no[order] = np.arange(len(sizes)) - first
            no += seen[sizes]
            seen += np.bincount(sizes, minlength=most + 1)
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(np.full(len(sizes), lane, dtype=np.int32)), pa.array(no)]
            yield pa.record_batch(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32", "lane", "no", "ids"][: 7 + with_ids])

    schema = f"doc_id {id_type(docs)}, piece int, start long, length long, ids_crc32 long, lane int, no long" + ", ids array<int>" * with_ids
    return materialise(docs.select("doc_id", "text").mapInArrow(run, schema))


class Rooms:
    """Open sequences by the room they have left: classes (first number, how many), under a segment tree that counts them."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.below = [0] * (2 * self.width)
        self.classes: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, n: int) -> None:
        at = room + self.width
        while at:
            self.below[at] += n
            at >>= 1

    def put(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.classes[room].append((first, n))
            self._add(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        self._add(room, -1)
        return self.classes[room].pop()

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that an open sequence has."""
        at = length + self.width
        while not self.below[at]:
            while at & 1:  # a right child: go up
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.width:
            at = 2 * at if self.below[2 * at] else 2 * at + 1
        return at - self.width


def plan(counts: dict[int, int], most: int = MOST) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank, pieces, sequence, each, offset): from that rank on, so many pieces of the length go to consecutive
    sequences, ``each`` to one, side by side from ``offset``."""
    rooms, sequences, out = Rooms(most), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, first, n = most, sequences, -(-left // (most // length))
                sequences += n
            else:
                first, n = rooms.take(room)
            each = room // length
            full = min(n, left // each)
            for bins, take in ((full, each), (min(1, n - full), left - full * each)):
                if bins and 0 < take <= each:
                    out.append((length, rank, bins * take, first, take, most - room))
                    rooms.put(room - take * length, first, bins)
                    rank, left, first, n = rank + bins * take, left - bins * take, first + bins, n - bins
            rooms.put(room, first, n)
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, most: int = MOST, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    spark = docs.sparkSession
    cut = pieces(docs, vocabulary, most, end, with_ids)
    lanes = materialise(cut.groupBy("length", "lane").agg((F.max("no") + 1).alias("n")))
    counts = {r["length"]: r["n"] for r in lanes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``most`` rows
    base = dict(zip(sorted(counts), np.concatenate([[0], np.cumsum([counts[k] for k in sorted(counts)])]).tolist(), strict=False))
    steps = np.array(sorted((base[length] + rank, sequence, each, offset, length) for length, rank, _, sequence, each, offset in plan(counts, most)), dtype=np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast((steps, np.array([base.get(k, 0) for k in range(most + 1)], dtype=np.int64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, base = sent.value
        for batch in batches:
            rank = batch.column("rank").to_numpy() + base[batch.column("length").to_numpy()]
            at = np.searchsorted(steps[:, 0], rank, "right") - 1
            first, sequence, each, offset, length = steps[at].T
            rank = rank - first
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence + rank // each), pa.array(offset + rank % each * length)], names=[*names, "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    names = [c for c in cut.columns if c not in ("lane", "no")]
    ranked = cut.join(maybe_broadcast(materialise(lanes)), ["length", "lane"]).select(*names, (F.col("no") + F.col("before")).alias("rank"))
    schema = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in names)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the token ids of each sequence, from pieces packed with their ids; at most ``most`` a row."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(own, lambda x: x["ids"])).alias("ids"))
