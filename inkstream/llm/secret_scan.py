"""Secrets in text: three base patterns, and a linear-chain conditional random field that adds spans.

Base patterns are matched leftmost and without overlap for each kind, on the whole text; matches that are too short are
dropped.  The field tags tokens (runs of ``[A-Za-z0-9+/_.=-]``) as begin, inside or outside of a secret, from their
shape, the neighbouring words and features of the document.  Tokens of at least ``LEAST`` characters with
a digit, those of ``LONG`` without one, the tokens of any kind and length that follow a cue word (``NEAR`` of them, within ``REACH`` characters) and
those between a colon and an at sign can be begin or inside; the others are outside for certain, so the best path is
found piece by piece between them, which is the best path of the whole chain.  Decoding is by Viterbi.

It is trained in numpy on the base matches of at most ``TRAIN_DOCS`` documents, picked by a hash of the id, of a repeated
id one text, and of each at most ``MOST_PIECES`` chains with and without a match, of at most ``MOST_TOKENS`` tokens.  Near misses
(matches that are too short, hexadecimal tokens, what stands after a cue word and a colon or equals sign or before an at
sign) have no label: chains are parted there.  Base matches are also shown cut short, without the word
that announces them, and with characters drawn anew, as secrets.  Spans it
finds are added unless they touch a base span.  Without a base match to learn from nothing is added.

Positions are code points, the end exclusive.  Null texts are empty and have no spans.  Repeated rows give a row each.
A byte-wise filter (superset of all patterns) keeps most documents from being decoded; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log2
from string import ascii_letters
from string import digits as digits_
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import configure
from . import words as W
from .store import id_type

# The kinds in their order, their patterns, what is measured and its least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))

LEAST, LONG, TRAIN_DOCS, MOST_PIECES, MOST_TOKENS, BITS = 8, 24, 20_000, 500, 64, 13
OUT, BEGIN, INSIDE = 0, 1, 2
NEAR, REACH = 2, 24
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: Words that a secret may follow; the userinfo of an address; what stands between a cue and its value.
_CUE = re.compile(r"pass(?:w(?:or)?d|phrase|code|wd)?|pwd|secret|token|key|auth|login|credentials?|bearer", re.I | re.A)
_INFO = re.compile(r":([A-Za-z0-9+/_.=-]+)@")
_ASSIGNED = re.compile(r"[\"']?\x20*[:=]\x20*[\"']?\Z")
_WORD_BEFORE = re.compile(r"([A-Za-z]{1,32})[^A-Za-z]{0,8}\Z")
_KEYS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"login", b"credential", b"bearer", b"api", b"akia", b"@")

_CLASS = np.zeros(256, dtype=bool)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
_HEXES = np.zeros(256, dtype=bool)
_HEXES[list(b"0123456789abcdef")] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[list(b"0123456789")] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, number of the kind, end; in order."""
    out = []
    for k, (_, pattern, group, least) in enumerate(KINDS):
        if k == 2 and len(text) > 256:  # the same matches: a run is matched whole, and shorter ones are dropped
            pattern = _LONG_HEX
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


_LONG_HEX = re.compile(r"[0-9a-f]{16,}")


def _runs(inside: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of True begin and end; a run ends where a text does."""
    around = np.concatenate([[False], inside, [False]])
    return np.flatnonzero(inside & (~around[:-2] | edge[:-1])), np.flatnonzero(inside & (~around[2:] | edge[1:])) + 1


def suspicious(w: W.Words, sizes: np.ndarray) -> np.ndarray:
    """Which texts may hold a base match or a token that can be tagged; ``w.data`` is lower-cased."""
    where = np.concatenate([[0], np.cumsum(sizes)])
    edge = np.zeros(len(w.data) + 1, dtype=bool)
    edge[where] = True
    marks = []
    data = w.data.tobytes()
    for key in _KEYS:
        at = data.find(key)
        while at >= 0:
            marks.append(at)
            at = data.find(key, at + 1)
    a, b = _runs(_HEXES[w.data], edge)
    marks += a[b - a >= 16].tolist()
    a, b = _runs(_CLASS[w.data], edge)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[w.data])])
    marks += a[(b - a >= LONG) | (b - a >= LEAST) & (digits[b] > digits[a])].tolist()
    out = np.zeros(len(sizes), dtype=bool)
    out[np.searchsorted(where, np.array(marks, dtype=np.int64), "right") - 1] = True
    return out


_SHAPE = str.maketrans(ascii_letters + digits_, "a" * 26 + "A" * 26 + "0" * 10)
_REPEATED = re.compile(r"(.)\1+")
_HEX_DIGITS, _SYMBOLS = frozenset("0123456789abcdefABCDEF"), frozenset("+/_.=-")


def _number(*parts: object) -> int:
    return crc32(repr(parts).encode()) >> (32 - BITS)


def _candidates(text: str, around: list[tuple[int, int, int]] = []) -> list[re.Match]:  # noqa: B006
    """The tokens that can be tagged, and those before and after the spans ``around``."""
    tokens = list(_TOKEN.finditer(text))
    starts = [m.start() for m in tokens]
    near = {bisect_left(starts, m.start(1)) for m in _INFO.finditer(text)}
    near.update(k for lo, _, hi in around for k in (bisect_left(starts, lo) - 1, bisect_left(starts, hi)))
    for cue in _CUE.finditer(text):
        at = bisect_left(starts, cue.end())
        near.update(k for k in range(at, min(at + NEAR, len(tokens))) if starts[k] <= cue.end() + REACH)
    return [m for k, m in enumerate(tokens) if k in near or (n := m.end() - m.start()) >= LONG or n >= LEAST and any(c in "0123456789" for c in m[0])]


def _near_misses(text: str) -> list[tuple[int, int]]:
    """Where something like a secret stands that no base pattern takes; no label for training."""
    out = [(m.start(), m.end()) for _, pattern, group, least in KINDS[:2] for m in pattern.finditer(text) if m.end(group) - m.start(group) < least]
    out += [m.span() for m in _TOKEN.finditer(text) if LEAST <= m.end() - m.start() < 16 and HEX.fullmatch(m[0]) and not m[0].isdigit() and not m[0].isalpha()]
    out += [m.span(1) for m in _INFO.finditer(text)]
    for cue in _CUE.finditer(text):
        m = _TOKEN.search(text, cue.end(), cue.end() + REACH)
        if m and _ASSIGNED.fullmatch(text[cue.end() : m.start()]):
            out.append((m.start(), m.end()))
    return out


def pieces(text: str, around: list[tuple[int, int, int]] = []) -> list[list[tuple[int, int, list[int]]]]:  # noqa: B006
    """Runs of neighbouring tokens that can be tagged (and of those around spans): start, end and features of each."""
    found = _candidates(text, around)
    many, long = min(len(found), 4), len(text).bit_length() // 3
    out: list[list] = []
    last = None
    for m in found:
        token, lo, hi = m[0], m.start(), m.end()
        size, kinds = len(token), token.translate(_SHAPE)
        digits, upper, lower = kinds.count("0"), kinds.count("A"), kinds.count("a")
        seen = Counter(token)
        entropy = log2(size) - sum(n * log2(n) for n in seen.values() if n > 1) / size
        before = _WORD_BEFORE.search(text, max(0, lo - 64), lo)
        shape = _REPEATED.sub(r"\1", kinds[:64])
        own = [
            _number("bias"),
            _number("length", min(len(token) // 4, 12)),
            _number("kinds", upper > 0, lower > 0, digits == len(token)),
            _number("digits", 8 * digits // len(token)),
            _number("upper", 8 * upper // len(token)),
            _number("entropy", int(2 * entropy)),
            _number("shape", shape[:6]),
            _number("first", token[:4] if token[:4].isalpha() else shape[:2]),
            _number("hex", _HEX_DIGITS.issuperset(seen)),
            _number("symbols", "".join(sorted(_SYMBOLS.intersection(seen)))),
            _number("head", re.split(r"[^A-Za-z]", token, maxsplit=1)[0].lower() if "=" in token[:-2] else ""),
            _number("before", before[1].lower() if before else ""),
            _number("left", text[max(0, lo - 2) : lo]),
            _number("right", text[hi : hi + 1]),
            _number("file", many, long),
        ]
        if last is None or any(c.isalnum() for c in text[last:lo]):
            out.append([])
        out[-1].append((lo, hi, own))
        last = hi
    return out


def _touching(spans: list[tuple[int, int]]) -> Callable[[int, int], int | None]:
    """Ask, from left to right, which of the spans (in order) is the first that [lo, hi) touches; all questions together walk the list once."""
    at = 0

    def ask(lo: int, hi: int) -> int | None:
        nonlocal at
        while at < len(spans) and spans[at][1] <= lo:
            at += 1
        return at if at < len(spans) and spans[at][0] < hi else None

    return ask


def _truth(piece: list[tuple[int, int, list[int]]], touched: Callable[[int, int], int | None]) -> list[int]:
    tags, last = [], None
    for lo, hi, _ in piece:
        own = touched(lo, hi)
        tags.append(OUT if own is None else INSIDE if own == last else BEGIN)
        last = own
    return tags


def _labelled(piece: list[tuple[int, int, list[int]]], touched: Callable[[int, int], int | None], missed: Callable[[int, int], int | None]) -> Iterator[list[tuple[int, int, list[int]]]]:
    """The piece in parts of at most ``MOST_TOKENS``, without near misses that no base span touches."""
    part: list = []
    for x in piece:
        if len(part) == MOST_TOKENS:
            yield part
            part = []
        lo, hi, _ = x
        if missed(lo, hi) is not None and touched(lo, hi) is None:
            if part:
                yield part
            part = []
        else:
            part.append(x)
    if part:
        yield part


def _shortened(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[list[tuple[int, int, list[int]]], list[tuple[int, int, int]]]]:
    """Base matches cut to less than their least length, in their surroundings: a length is no part of what a secret is."""
    for lo, k, hi in spans:
        _, pattern, group, least = KINDS[k]
        value = pattern.match(text, lo).start(group)
        end = value + least // 2 + crc32(text[value:hi].encode()) % (least - least // 2)
        if text[value:end].isdigit():
            continue
        at = max(0, lo - 80)
        near, own = text[at:end] + text[hi : hi + 80], (lo - at, k, end - at)
        for piece in pieces(near, [own]):
            if any(a < own[2] and own[0] < b for a, b, _ in piece):
                yield piece, sorted([own, *(s for s in base_spans(near) if s[2] <= own[0] or own[2] <= s[0])])


def _without_cue(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[list[tuple[int, int, list[int]]], list[tuple[int, int, int]]]]:
    """Base matches among the words around without what announces them, as they are and with their characters drawn
    anew from letters of both cases and digits: a secret is one by its own shape, not by a pattern's words or alphabet."""
    for lo, k, hi in spans:
        value = KINDS[k][1].match(text, lo).start(KINDS[k][2])
        draw = random.Random(crc32(text[value:hi].encode()))
        anew = "".join(draw.choices(ascii_letters + digits_, k=min(hi - value, draw.randint(10, 44))))
        before, after = text[max(0, lo - 80) : lo], text[hi : hi + 80]
        for token in (text[value:hi], anew):
            own = [(len(before), k, len(before) + len(token))]
            for piece in pieces(before + token + after, own):
                # The match alone: what else stands near by has chains of its own.
                part = [x for x in piece if x[0] < own[0][2] and own[0][0] < x[1]]
                if part:
                    yield part, own


@dataclass
class Field:
    """emit: feature by tag; move: tag before by tag after; the chain begins after an outside token."""

    emit: np.ndarray
    move: np.ndarray
    trained: bool = True

    def decode(self, features: list[list[int]]) -> list[int]:
        """The best tags, by Viterbi."""
        best, back = self.emit[features[0]].sum(axis=0) + self.move[OUT], []
        for own in features[1:]:
            paths = best[:, None] + self.move
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + self.emit[own].sum(axis=0)
        best = best + self.move[:, OUT]
        tags = [int(best.argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]


def _allowed() -> np.ndarray:
    move = np.zeros((3, 3))
    move[OUT, INSIDE] = -1e4  # inside follows begin or inside
    return move


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(chains: list[tuple[list[list[int]], list[int]]], steps: int = 120, l2: float = 1e-3, rate: float = 0.2) -> Field:
    """Maximum likelihood by forward and backward sums, over chains of equal length at once."""
    emit, move = np.zeros((1 << BITS, 3)), np.zeros((3, 3))
    if not any(tag != OUT for _, tags in chains for tag in tags):
        return Field(emit, move, trained=False)
    by_length: dict[int, list] = {}
    for features, tags in chains:
        by_length.setdefault(len(tags), []).append((features, tags))
    groups = [(np.array([x[0] for x in own]), np.array([x[1] for x in own])) for own in by_length.values()]
    n = len(chains)
    state = [np.zeros_like(x) for x in (emit, emit, move, move)]
    for step in range(1, steps + 1):
        g_emit, g_move = l2 * emit, l2 * move
        full = move + _allowed()
        for features, tags in groups:
            m, length, _ = features.shape
            scores = emit[features].sum(axis=2)
            fore, back = np.zeros((length, m, 3)), np.zeros((length, m, 3))
            fore[0] = scores[:, 0] + full[OUT]
            for t in range(1, length):
                fore[t] = _log_sum(fore[t - 1][:, :, None] + full, 1) + scores[:, t]
            back[-1] = full[:, OUT]
            for t in range(length - 2, -1, -1):
                back[t] = _log_sum(full + (scores[:, t + 1] + back[t + 1])[:, None, :], 2)
            total = _log_sum(fore[-1] + back[-1], 1)
            for t in range(length):
                belief = np.exp(fore[t] + back[t] - total[:, None])
                belief[np.arange(m), tags[:, t]] -= 1
                np.add.at(g_emit, features[:, t], belief[:, None, :] / n)
                before = tags[:, t - 1] if t else np.zeros(m, int)
                if t:
                    pair = np.exp(fore[t - 1][:, :, None] + full + (scores[:, t] + back[t])[:, None, :] - total[:, None, None])
                    g_move += pair.sum(axis=0) / n
                else:
                    g_move[OUT] += np.exp(fore[0] + back[0] - total[:, None]).sum(axis=0) / n
                np.add.at(g_move, (before, tags[:, t]), -1 / n)
            g_move[:, OUT] += np.exp(fore[-1] + back[-1] - total[:, None]).sum(axis=0) / n
            np.add.at(g_move, (tags[:, -1], np.zeros(m, int)), -1 / n)
        for x, g, first, second in ((emit, g_emit, state[0], state[1]), (move, g_move, state[2], state[3])):
            first += 0.1 * (g - first)
            second += 0.001 * (g**2 - second)
            x -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field(emit, move + _allowed())


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> Field:
    """A field from the base matches of at most ``most`` documents."""
    configure(docs.sparkSession)
    chosen = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, tags = [], []

            def bounded() -> None:
                # By where a chain stands, spread over the whole text.
                at = sorted(range(first, len(tags)), key=lambda k: crc32(b"%d" % k))
                for wanted in (True, False):
                    own = [k for k in at if (max(tags[k]) > OUT) is wanted]
                    drop.update(own[MOST_PIECES:])

            drop: set[int] = set()
            for text in batch.column("text").to_pylist():
                first = len(tags)
                spans = base_spans(text or "")
                walk = lambda own: _touching([(s[0], s[-1]) for s in own])
                touched, missed, true = walk(spans), walk(sorted(_near_misses(text or ""))), walk(spans)
                for piece in pieces(text or "", spans):  # with ordinary words beside secrets
                    for part in _labelled(piece, touched, missed):
                        features.append([x[2] for x in part])
                        tags.append(_truth(part, true))
                for part, own in (*_shortened(text or "", spans), *_without_cue(text or "", spans)):
                    features.append([x[2] for x in part])
                    tags.append(_truth(part, walk(own)))
                if len(tags) - first > MOST_PIECES:
                    bounded()
            features, tags = ([x for k, x in enumerate(y) if k not in drop] for y in (features, tags))
            yield pa.record_batch([pa.array(features, pa.list_(pa.list_(pa.int32()))), pa.array(tags, pa.list_(pa.int32()))], names=["features", "tags"])

    # At most ``most`` ids, each once, as combined on the map side.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    own = rows.select("text").mapInArrow(run, "features array<array<int>>, tags array<int>").toArrow()
    return fit(list(zip(own.column("features").to_pylist(), own.column("tags").to_pylist(), strict=True)))


def field_spans(text: str, field: Field) -> list[tuple[int, int]]:
    """What the field alone takes for secrets: start and end."""
    out = []
    for piece in pieces(text) if field.trained else ():
        tags, lo, hi = field.decode([x[2] for x in piece]), None, None
        for (a, b, _), tag in [*zip(piece, tags, strict=True), ((None, None, None), OUT)]:
            if tag != INSIDE and lo is not None:
                out.append((lo, hi))
                lo = None
            if tag == BEGIN:
                lo = a
            if tag != OUT:
                hi = b
    return out


def all_spans(text: str, field: Field) -> list[tuple[int, int, int]]:
    """Base spans, and those that the field adds (kind 3)."""
    base = base_spans(text)
    touched = _touching([(s[0], s[2]) for s in base])
    return sorted(base + [(lo, 3, hi) for lo, hi in field_spans(text, field) if touched(lo, hi) is None])


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and spans (kind, first, last) of every row."""
    configure(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)
    names = [k[0] for k in KINDS] + ["crf"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            for rows, w in W.parts(batch, "text"):
                sizes = pc.binary_length(rows.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
                out: list[list[dict]] = [[] for _ in range(rows.num_rows)]
                for i in np.flatnonzero(suspicious(w, sizes)):
                    out[i] = [{"kind": names[k], "first": a, "last": b} for a, k, b in all_spans(rows.column("text")[int(i)].as_py(), sent.value)]
                yield pa.record_batch([rows.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, spans array<struct<kind:string,first:long,last:long>>")


def digest(found: DataFrame) -> DataFrame:
    show = lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["last"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.array_join(F.transform(base, show), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", show), ",").alias("spans"))


def spans_sha256(spans: list[tuple[int, int, int]]) -> str:
    """The digest of base spans, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
