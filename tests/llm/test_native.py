"""Exact duplicates, chat formatting, repeated lines, mixing: against SQL twins, brute force and hard rows."""

import hashlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstream.llm import chat, exact_dedup, line_dedup, mixing
from inkstream.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None, source="s"):
    return spark.createDataFrame([(i, t, None, source, None) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_twin(spark, twin, name):
    twin(queries()[name](spark, SF), oracle_sql()[name])


def brute_dedup(rows):
    squeeze = lambda t: (t or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})
    best = {}
    for i, t in rows:
        best.setdefault(squeeze(t), []).append((-len(t or ""), i))
    return sorted((i, min(best[squeeze(t)])[1], len(best[squeeze(t)]), hashlib.sha256(squeeze(t).encode()).hexdigest()) for i, t in rows)


HARD = ["a b", "ab", "a\nb ", None, "", " \t", "é x", "éx", "ab" * 40_000, "AB", "a b", "a  b"]


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda n: F.substring(n, 1, 1)])
def test_exact_dedup(spark, hashed):
    docs = docs_of(spark, HARD)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.duplicates(docs, hashed).collect())
    assert got == brute_dedup(list(enumerate(HARD)))


def test_exact_dedup_kept_and_clashing_columns(spark):
    docs = docs_of(spark, ["x", "x ", "y", None, None], [5, 4, None, 1, 2]).withColumn("h", F.lit(1)).withColumn("keep_id", F.lit(2)).withColumn("gone_id", F.lit(3)).withColumn("gone_texts", F.lit(3)).withColumn("twice_id", F.lit(1))
    kept = exact_dedup.kept(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "None"]
    assert exact_dedup.duplicates(docs.limit(0)).count() == 0
    assert exact_dedup.kept(docs.limit(0)).count() == 0
    # Of rows that share id and text one stays, the longest; rows without an id are told apart by their text.
    twice = exact_dedup.kept(docs.union(docs).union(docs_of(spark, ["y ", "z"], [None, None]).select(*docs.columns[:5], *(F.lit(1) for _ in docs.columns[5:]))))
    assert twice.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in twice.collect()) == [("1", "None"), ("4", "x "), ("None", "y "), ("None", "z")]


def test_exact_dedup_compares_bytes_without_ids(spark):
    """Hashes that collide: rows without an id, and rows that share one, are still told apart by their bytes."""
    docs = docs_of(spark, ["ab", "ac", "a b", "ac", "bd"], [None, None, None, 3, 3])
    first = lambda n: F.substring(n, 1, 1)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in exact_dedup.duplicates(docs, first).collect())
    assert got == [("3", "3", 1), ("3", "None", 2), ("None", "None", 2), ("None", "None", 2), ("None", "None", 2)]
    assert sorted((str(r.doc_id), r.text) for r in exact_dedup.kept(docs, first).collect()) == [("3", "bd"), ("None", "a b"), ("None", "ac")]


TALK = "conv_id long, turn long, role string, text string"


def brute_chat(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {
        c: (len(v), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in sorted(v)).encode()).hexdigest(), hashlib.sha256("".join(x for _, _, r, x in sorted(v) if r == "assistant").encode()).hexdigest())
        for c, v in out.items()
    }


CHAT = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nno"), (1, 2, "assistant", ""), (2, 0, "assistant", "<\\|im_end|> <\\\\|x|>"), (2, 1, None, None), (2, None, "a\nb", "\n\n"),
    (3, 0, "assistant", "x\n<|im_end|>\n"), (3, 0, "assistant", "x\n<|im_end|>\n"), (4, 0, "assistant", "<|escaped|>\n<|im_start|>"), (5, 7, "<|nl|>", "<|"), (None, 0, "user", "é😀" * 2000), (6, 0, "assistant", "ends with <"), (6, 1, "assistant", "|im_end|>"),
]


def check_chat(spark, rows):
    done = chat.format_conversations(spark.createDataFrame(rows, TALK))
    assert done.where("NOT round_trip").count() == 0
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_sha256) for r in chat.digest(done).collect()}
    assert got == brute_chat(rows)


def test_chat_hard_rows(spark):
    check_chat(spark, CHAT)
    assert chat.format_conversations(spark.createDataFrame([], TALK)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 3), st.sampled_from(["user", "assistant", "a<|\n"]), st.text("<|\\im_endstar>\n x", max_size=30)), min_size=1, max_size=8))
def test_chat_any_text(spark, rows):
    check_chat(spark, rows)


def brute_lines(rows, least):
    docs = sorted(rows)
    grams, gone = {}, {}
    for i, t in docs:
        lines = [x.strip(" ") for x in (t or "").split("\n")]
        words = [x.count(" ") + 1 for x in lines]
        found = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(words[a : b + 1]) >= least:
                    found.add((a, b))
                    break
        for b in range(len(lines)):
            for a in range(b, -1, -1):
                if sum(words[a : b + 1]) >= least:
                    found.add((a, b))
                    break
        for a, b in sorted(found):
            key = tuple(lines[a : b + 1])
            if key in grams:
                gone.setdefault(i, set()).update(range(a, b + 1))
            else:
                grams[key] = i
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone.get(i, ())) for i, t in docs}


def test_line_dedup(spark):
    long = " ".join(f"w{k}" for k in range(12))
    texts = [f"a b\n{long}\nc", f"start\n{long}\nend", "x y z\np q r\ns t u v w", "head\nx y z\np q r\ns t u v w\ntail", None, "", "\n\n\n\n\n\n\n\n\n\n\n", "\n\n\n\n\n\n\n\n\n\n\n", "one\n" * 30, f" {long} ", "q"]
    got = line_dedup.deduplicated(docs_of(spark, texts).withColumn("runs", F.lit(1)).withColumn("key", F.lit(2)), 10)
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(list(enumerate(texts)), 10)
    assert line_dedup.digest(docs_of(spark, texts).limit(0)).count() == 0


def test_line_dedup_repeated_rows(spark):
    long = " ".join(f"w{k}" for k in range(60))
    docs = docs_of(spark, [long, long, f"x\n{long}"], [1, 1, None])
    got = sorted((str(r.doc_id), r.n_removed) for r in line_dedup.digest(docs).collect())
    assert got == [("1", 1), ("1", 1), ("None", 0)]


@pytest.mark.parametrize("weights", [{"a": 4, "b": 3, "c": 1}, {"a": 1}, {"a": 7, "b": 7, "c": 7, "d": 5}, {"x": 1, "y": 99}])
def test_schedule_stays_within_a_block(weights):
    order = mixing.schedule(weights)
    total = sum(weights.values())
    for name, w in weights.items():
        seen = 0
        for slot, own in enumerate(order, 1):
            seen += own == name
            assert abs(seen - Fraction(slot * w, total)) < 1
        assert seen == w


def test_plan_against_simulation(spark):
    rows = [(i, "x" * (1 + i * 37 % 90), None, ["a", "b", None][i % 3 if i % 2 else 0], None) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.plan(docs, {"a": 3, "b": 2}, block_chars=64, bucket_rows=16).collect()
    assert len(got) == 200
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    weights = {"a": 3, "b": 2, "": 1}
    order = mixing.schedule(weights)
    slots = {name: [s for s, x in enumerate(order) if x == name] for name in weights}
    want = {}
    for name in weights:
        at = 0
        for i in sorted((r[0] for r in rows if (r[3] or "") == name), key=lambda i: hashes[i]):
            block = at // 64
            want[i] = (name, block, block // weights[name] * 6 + slots[name][block % weights[name]], at - block * 64)
            at += len(rows[i][1])
    assert {r.doc_id: (r.source, r.block, r.slot, r.seq) for r in got} == want
    assert all(r.release <= r.slot < r.deadline for r in got)
    mixed = mixing.mixed(docs)
    assert mixed.count() == 200 and mixed.columns[:5] == docs.columns
    assert mixing.plan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule({"a": 0})


def test_sources_of_one_weight_share_their_slots(spark):
    """As one group; each still keeps its releases and deadlines, and no slot is taken twice."""
    rows = [(i, "x" * 40, None, f"s{i % 23}" if i % 4 else "big", None) for i in range(3_000)]
    got = mixing.plan(spark.createDataFrame(rows, DOCS), {"big": 7, "s1": 2}, block_chars=64, bucket_rows=32).collect()
    assert len(got) == 3_000 and all(r.release <= r.slot < r.deadline for r in got)
    blocks = {(r.slot, r.source, r.block) for r in got}
    assert len({s for s, _, _ in blocks}) == len(blocks)
    total = 7 + 2 + 22
    weights = {r.source: {"big": 7, "s1": 2}.get(r.source, 1) for r in got}
    for s, w in weights.items():
        for k, slot in enumerate(own := sorted(x for x, name, _ in blocks if name == s)):
            assert abs(k - Fraction(slot * w, total)) < 1 and abs(k + 1 - Fraction((slot + 1) * w, total)) < 1, own


def test_mixing_and_lines_of_very_long_texts(spark):
    long = "\n".join(f"line {k} of a long text with some words" for k in range(20_000))
    docs = docs_of(spark, [long, long + "\nend", "a"])
    assert {(r.doc_id, r.n_removed) for r in line_dedup.digest(docs).collect()} == {(0, 0), (1, 20_000), (2, 0)}
    assert {r.doc_id for r in mixing.plan(docs).collect()} == {0, 1, 2}
