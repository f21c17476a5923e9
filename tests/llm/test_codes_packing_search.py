"""Vector codes, packing and ranked search: against plain loops, SQL and hard rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from inkstream.llm import lexical_search as L
from inkstream.llm import packing, queries, vector_codes
from inkstream.llm import words as W
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>, label int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_lexical_search"])
def test_sql_twin(spark, twin, name):
    twin(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def plain_codes(rows, parts, entries, rounds):
    """One vector at a time, whole numbers of any size."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(1024 * x) for x in r[1]] for r in rows]
    w = len(ints[0]) // parts
    cut = [[v[k * w : k * w + w] for k in range(parts)] for v in ints]
    books = [[v[k] for v in cut[:entries]] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda k, p: min((far(p, c), i) for i, c in enumerate(books[k]))
    for _ in range(rounds):
        own = [collections.defaultdict(list) for _ in range(parts)]
        for v in cut:
            for k in range(parts):
                own[k][near(k, v[k])[1]].append(v[k])
        for k in range(parts):
            for e, members in own[k].items():
                books[k][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    best = [[near(k, v[k]) for k in range(parts)] for v in cut]
    error = [sum(d for d, _ in b) for b in best]
    by_label = collections.Counter()
    for r, e in zip(rows, error, strict=True):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(repr((r[0], "".join(f"{i:02x}" for _, i in b), e, by_label[r[2]], sha)) for r, b, e in zip(rows, best, error, strict=True))


def codes(df, **how):
    return sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in vector_codes.digest(df, **how).collect())


@pytest.mark.parametrize("entries", [3, 8, 256])
def test_codes_against_a_plain_loop_with_ties_and_repeats(spark, entries):
    rng = random.Random(entries)
    rows = [(rng.choice([None, *range(40)]), [float(np.float32(rng.choice([-1.5, -0.001, 0.0, 0.25, rng.uniform(-3, 3)]))) for _ in range(8)], rng.choice([None, 1, 2])) for _ in range(90)]
    rows += rows[:20] + [(5, [0.5] * 8, 1)] * 30
    df = spark.createDataFrame(rows, VECTORS).repartition(7)
    assert codes(df, entries=entries) == plain_codes(rows, 4, entries, 4)


def test_codes_of_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i), 1.0, 2.0, 3.0], None if i % 2 else 7) for i in range(5)]
    bad = [(10, None, 1), (11, [1.0, None, 1.0, 1.0], 1), (12, [nan, 1.0, 1.0, 1.0], 1), (13, [1.0, inf, 1.0, 1.0], 1), (14, [1.0, -inf, 1.0, 1.0], 1)]
    df = spark.createDataFrame(good + bad, VECTORS).withColumn("code", F.lit(1)).withColumn("ints", F.lit("x")).withColumn("error", F.lit(2))
    assert codes(df) == plain_codes(good, 4, 256, 4)
    # Vectors of another length keep their rows; a length that four doesn't divide can't be cut.
    got = {r.vec_id: r for r in vector_codes.digest(spark.createDataFrame(good + [(20, [1.0] * 8, 7), (21, [], 7), (22, [1.0] * 3, 7)], VECTORS)).collect()}
    assert len(got) == 8 and all(got[k].code is None and got[k].error is None for k in (20, 21, 22)) and got[20].label_error == got[0].label_error
    odd = vector_codes.digest(spark.createDataFrame([(1, [1.0] * 3, 1)], VECTORS)).collect()
    assert [(r.code, r.error, r.label_error) for r in odd] == [(None, None, None)]
    assert vector_codes.digest(df.limit(0)).count() == 0
    text = spark.createDataFrame([("a", [1.0] * 4, "x"), ("b", [2.0] * 4, None)], "vec_id string, embedding array<double>, label string")
    assert {r.vec_id: r.code for r in vector_codes.digest(text).collect()} == {"a": "00000000", "b": "01010101"}
    with pytest.raises(ValueError):
        vector_codes.digest(spark.createDataFrame([(1, [1e30] * 4, 1)], VECTORS))


def test_distances_are_exact_where_doubles_are_not():
    a, b = np.array([[2**28, 2**28]], dtype=np.int64), np.array([[-(2**28) + 1, -(2**28)], [-(2**28), -(2**28) + 1]], dtype=np.int64)
    at, far = vector_codes.nearest(a, b)
    assert at[0] == 0 and far[0] == (2**29 - 1) ** 2 + 2**58


def plain_best_fit(lengths, most):
    """One piece at a time: the open sequence with the least room; the sizes of all sequences."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(most - n)
    return sorted(most - r for r in rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    most = rng.choice([1, 7, 16, 64, 100])
    top = rng.choice([most, max(1, most // 3)])
    lengths = [rng.randint(1, top) for _ in range(rng.choice([0, 1, 50, 700]))] + [1] * rng.choice([0, 300])
    steps = packing.plan(dict(collections.Counter(lengths)), most)
    bins, placed = collections.defaultdict(list), collections.Counter()
    for length, rank, n, sequence, each, offset in steps:
        assert rank == placed[length]
        placed[length] += n
        for k in range(n):
            bins[sequence + k // each].append((offset + k % each * length, length))
    assert placed == collections.Counter(lengths)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
    assert sorted(sum(n for _, n in own) for own in bins.values()) == plain_best_fit(lengths, most)


def test_plan_stays_small_for_many_pieces():
    rng = random.Random(3)
    steps = packing.plan({n: rng.randint(1, 10**9) for n in range(1, 1025)})
    assert len(steps) < 40 * 1024


def test_tightest_room_against_a_scan():
    rng, rooms, own = random.Random(4), packing.Rooms(50), []
    for _ in range(400):
        if own and rng.random() < 0.5:
            room = rng.choice(own)
            rooms.take(room)
            own.remove(room)
        else:
            room = rng.randint(1, 50)
            rooms.put(room, 0, 1)
            own.append(room)
        for n in range(1, 51):
            assert rooms.tightest(n) == min((r for r in own if r >= n), default=None)


def whole_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def test_word_wise_ids_are_the_library_s():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encode = packing._Encoder(file.read())
    rng = random.Random(1)
    blocks = [0x300, 0x600, 0x900, 0x2100, 0x2000, 0x3000, 0x4E00, 0xAC00, 0xE000, 0xFF00, 0x10300, 0x1D700, 0x1F600, 0x20000, 0x3F500, 0x10FF00]
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x250), rng.choice(blocks) + rng.randrange(256), rng.choice([9, 10, 13, 32, 32, 0xA0, 0x2028])]))
    texts = ["".join(pick() for _ in range(rng.randrange(1, 14))) for _ in range(1500)] + ["it's <|endoftext|> we'll", "  a  \n\n b", "''s '' 's"]
    for text, want in zip(texts, whole_ids(texts), strict=True):
        assert np.frombuffer(encode(text), "<u4").tolist() == want[:-1]


@pytest.mark.parametrize("most", [16, 1024])
def test_packed_sequences_hold_every_token_once(spark, most):
    rows = [(1, None), (2, ""), (None, "one two three"), (None, None), (3, "word " * 9000), (3, "x" * 5000), (4, "same text"), (4, "same text"), (5, "Ünïcode \n\n text " * 30)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in ("piece", "lane", "no", "length", "rank", "sequence_id"):
        docs = docs.withColumn(name, F.lit("z"))
    packed = packing.pack(docs, most=most, with_ids=True)
    got = packed.collect()
    want = [(i, x) for (i, _), x in zip(rows, whole_ids([t for _, t in rows]), strict=True)]
    pieces = []
    for i, ids in want:
        first = (len(ids) - 1) % most + 1
        cuts = [0, *range(first, len(ids), most)]
        pieces += [(str(i), k, a, tuple(ids[a : (cuts + [len(ids)])[k + 1]])) for k, a in enumerate(cuts)]
    assert sorted((str(r.doc_id), r.piece, r.start, tuple(r.ids)) for r in got) == sorted(pieces)
    import zlib

    assert all(r.length == len(r.ids) <= most and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    filled = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in got:
        assert filled[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sum(map(len, filled.values())) == sum(len(x) for _, x in want) and max(map(len, filled.values())) <= most
    assert sorted(map(len, filled.values())) == plain_best_fit([len(p[3]) for p in pieces], most)


def test_packing_of_empty_tables_and_text_ids(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", None)], "doc_id string, text string")
    assert sorted((r.doc_id, r.length) for r in packing.pack(docs).collect()) == [("a", 3), ("b", 1)]
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_query_is_best_fit_over_the_whole_table(spark):
    rows = queries.queries()["op12_best_fit_packing"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(texts, map(len, whole_ids(texts.values())), strict=True))
    got = collections.Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want
    assert len({r.sequence_id for r in rows}) == len(plain_best_fit([r.length for r in rows], 1024))


def terms_of(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_search(docs, items, top):
    own = [(i, terms_of(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    df = collections.Counter(t for _, x in own for t in set(x))
    out = []
    for item, text in set(items):
        scores = []
        for i, x in own:
            tf = collections.Counter(x)
            m = 75 + (25 * len(x) * n_docs) // total if x else 75
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms_of(text) if tf[t])
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, k + 1, i if there else None, -s) for k, (s, there, i) in enumerate(sorted(scores)[:top])]
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r.item_id, r.rank, r.doc_id, r.score)) for r in df.collect())


@pytest.mark.parametrize(("leaf", "fan", "reach", "group", "block"), [(32, 16, 8192, 4096, 200_000), (2, 2, 64, 8, 200_000), (1, 4, 16, 4096, 10), (4, 2, 8, 3, 6)])
def test_search_against_all_scores(spark, monkeypatch, leaf, fan, reach, group, block):
    rng = random.Random(leaf)
    vocabulary = [f"w{k}" for k in range(30)] + ["Été", "averyveryverylongtermindeed", "averyveryverylongtermindeex", "a_b", "X9"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([3, 35])]) for _ in range(n))
    docs = [(rng.choice([None, *range(300)]), text(rng.randint(0, 25))) for _ in range(200)] + [(400, None), (401, ""), (402, "w1 " * 50_000)]
    docs += [(500 + k, "w3 w4 w5") for k in range(60)] + docs[:15]
    items = [(1, "w1 w2 W2 w30"), (2, "w3 w4"), (2, "w5"), (None, text(12)), (4, None), (5, "..."), (6, "nowhere"), (7, text(300)), (1, "w1 w2 W2 w30"), (8, "averyveryverylongtermindeed été")]
    for name, value in (("LEAF", leaf), ("FAN", fan), ("RANGE", reach), ("GROUP_TERMS", group)):
        monkeypatch.setattr(L, name, value)
    df = spark.createDataFrame(docs, DOCS).withColumn("n", F.lit(1)).withColumn("terms", F.lit("x")).withColumn("score", F.lit(0)).repartition(5)
    own = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(3))
    for top in (1, 20):
        assert found(L.search(df, own, top=top, block_terms=block)) == plain_search(docs, items, top)


def test_search_of_empty_tables_and_text_ids(spark):
    docs, items = spark.createDataFrame([("b", "x y"), ("a", "x y")], "doc_id string, text string"), spark.createDataFrame([("i", "x z")], "item_id string, text string")
    assert [(r.item_id, r.rank, r.doc_id) for r in sorted(L.search(docs, items).collect(), key=lambda r: r.rank)] == [("i", 1, "a"), ("i", 2, "b")]
    assert L.search(docs.limit(0), items).count() == 0 and L.search(docs, items.limit(0)).count() == 0


def test_terms_of_one_hash_are_told_apart():
    names = [b"a", b"b", b"longer than eight".replace(b" ", b"x"), b"longerxthanxeigh2", "é".encode()]
    known = L.Terms(sorted(names))
    known.hashes[:] = 7
    known.most = len(names)
    import pyarrow as pa

    w = W.split(pa.array(["a b c longerxthanxeight é", "longerxthanxeigh2 b longerxthanxeigh3"]))
    w.hashes[:] = 7
    places, at = known.find(w)
    assert sorted((int(p), known.terms[k].decode()) for p, k in zip(places, at, strict=True)) == [(0, "a"), (1, "b"), (3, "longerxthanxeight"), (4, "é"), (5, "longerxthanxeigh2"), (6, "b")]


def test_branch_and_bound_leaves_most_of_the_tree_closed_and_opens_ties():
    docs = 4096
    rng = np.random.default_rng(2)
    doc = np.arange(docs)
    impact = rng.integers(1, 100, docs)
    impact[1000] = 10**6
    tree = L.MaxTree(doc, np.zeros(docs, dtype=np.int64), impact, 1, docs)
    best = []
    assert tree.search(np.array([0]), np.array([3]), best, list(range(docs)), 1) == 1 and best == [(-3 * 10**6, True, 1000)]
    # Equal scores in two leaves: the one with the smaller id is found, whichever leaf is opened first.
    impact[:] = 1
    impact[[50, 3000]] = 9
    tree = L.MaxTree(doc, np.zeros(docs, dtype=np.int64), impact, 1, docs)
    for ids in (list(range(docs)), list(range(docs, 0, -1))):
        best = []
        assert tree.search(np.array([0]), np.array([1]), best, ids, 1) == 2 and best == [(-9, True, min(ids[50], ids[3000]))]
