"""What the field finds by itself, and what it adds to the base patterns."""

import collections
import random
import string
import time

import pytest
from pyspark.sql import functions as F

from inkstream.llm import secret_scan


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def field(docs):
    """Trained on half of the documents."""
    return secret_scan.train(docs.where("doc_id % 2 = 0"))


def test_field_finds_matches_it_was_not_shown(docs, field):
    """Base matches of the other half are hidden from training; the field alone finds them, and marks little else."""
    hidden = found = marked = wrong = 0
    for r in docs.where("doc_id % 2 = 1").collect():
        base, own = secret_scan.base_spans(r.text or ""), secret_scan.field_spans(r.text or "", field)
        hidden += len(base)
        found += sum(any(lo < s[2] and s[0] < hi for lo, hi in own) for s in base)
        marked += len(own)
        wrong += sum(not any(lo < s[2] and s[0] < hi for s in base) for lo, hi in own)
    assert hidden > 200 and found >= 0.95 * hidden
    assert marked > 0 and wrong <= 0.05 * marked


def test_field_adds_a_span(field):
    added = lambda text: [s for s in secret_scan.all_spans(text, field) if s[1] == 3]
    assert added("and the pass b7db7aa4a5fcc78 was there") == [(13, 3, 28)]
    assert not added("mail hsr.29@mail5.example.com or 42.144.35.254 on 4041894974608795, pass the salt")


def test_letters_and_short_tokens_can_be_tagged():
    own = lambda text: [text[a:b] for piece in secret_scan.pieces(text) for a, b, _ in piece]
    assert "longpassphrase" in own("user:longpassphrase@host")
    assert own("pass: hunter2") == ["hunter2"]
    assert own("a word and " + "kJhGdf" * 5) == ["kJhGdf" * 5]


def test_training_takes_a_repeated_id_once_and_bounds_a_text(spark):
    secret = "password=b7db7aa4a5fcc78305 and the plain word0001 "
    rows = [(1, secret * 2_000), (1, secret * 2_000), (2, "nothing"), (None, secret)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = secret_scan.train(docs.unionByName(docs))
    assert field.trained and secret_scan.scan(docs, field).select(F.size("spans").alias("n")).collect()[0].n >= 4_000


def hidden_kinds(rng):
    own = lambda n, alphabet=string.ascii_letters + string.digits: "".join(rng.choice(alphabet) for _ in range(n))
    return {
        "bearer": (f"Authorization: Bearer {(x := own(40))}", x),
        "userinfo": (f"https://user:{(x := own(16))}@host.example/x", x),
        "live key": (x := f"sk_live_{own(24)}", x),
        "phrase": (f"the pass phrase is {(x := own(14))} for now", x),
        "alone": (f"use {(x := own(32))} here", x),
        "upper hex": (f"id {(x := own(32, '0123456789ABCDEF'))} ok", x),
    }


def test_field_finds_kinds_that_the_patterns_miss(docs, field):
    rng = random.Random(5)
    clean = [r.text for r in docs.where("doc_id % 2 = 1 AND length(text) > 200").limit(2_000).collect() if not secret_scan.base_spans(r.text)]
    right, wrong, hidden = collections.Counter(), 0, 0
    for _ in range(60):
        for kind, (line, secret) in hidden_kinds(rng).items():
            text = rng.choice(clean)
            at = text.index(" ", len(text) // 2) if " " in text[len(text) // 2 :] else len(text)
            text = f"{text[:at]} {line} {text[at:]}"
            lo = text.index(secret)
            added = [(a, b) for a, k, b in secret_scan.all_spans(text, field) if k == 3]
            base = any(a < lo + len(secret) and lo < b for a, _, b in secret_scan.base_spans(text))
            hidden += not base
            right[kind] += base or any(a < lo + len(secret) and lo < b for a, b in added)
            wrong += sum(not (a < lo + len(secret) and lo < b) for a, b in added)
    assert min(right.values()) >= 40 and sum(right.values()) >= 0.85 * 360 and wrong <= 0.05 * 360 and hidden > 300


def test_a_text_of_many_secrets_is_read_in_linear_time():
    line = lambda n: " ".join(f"{k * 7919**9 % 2**128:032x}" for k in range(n))
    took = []
    for n in (5_000, 50_000):
        text = line(n)
        began = time.process_time()
        base = secret_scan.base_spans(text)
        touched, missed, true = (secret_scan._touching([(s[0], s[-1]) for s in own]) for own in (base, sorted(secret_scan._near_misses(text)), base))
        tags = [t for piece in secret_scan.pieces(text, base) for part in secret_scan._labelled(piece, touched, missed) for t in secret_scan._truth(part, true)]
        took.append(time.process_time() - began)
        assert len(tags) == n and set(tags) == {secret_scan.BEGIN}
    assert took[1] < 25 * took[0]


@pytest.mark.parametrize("seed", range(20))
def test_spans_touched_from_left_to_right_against_a_scan(seed):
    rng = random.Random(seed)
    spans = sorted((a, a + rng.randint(1, 12)) for a in (rng.randrange(100) for _ in range(12)))
    ask, at = secret_scan._touching(spans), 0
    for _ in range(30):
        at += rng.randint(0, 5)
        hi = at + rng.randint(1, 6)
        assert ask(at, hi) == next((i for i, (a, b) in enumerate(spans) if a < hi and at < b), None)
