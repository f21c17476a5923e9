"""Each row is judged by its own text, whatever its id."""

import pytest
from inkstream.llm import decontaminate, jaccard

DOCS = "doc_id long, text string"
LEAK = "the quick brown fox jumps over the lazy dog again"
OTHER = "some words of no benchmark that are ten in all"
ITEMS = [(1, LEAK), (2, "another benchmark passage that stands in no document at all here")]


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontaminate_rows_without_an_id_or_with_the_same(spark, block):
    rows = [(None, LEAK), (None, OTHER), (None, None), (7, OTHER), (7, LEAK), (8, LEAK), (8, LEAK), (9, OTHER)]
    docs, items = spark.createDataFrame(rows, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    found = [(str(r.doc_id), r.n_words, len(r.spans), r["items"]) for r in decontaminate.overlaps(docs, items, block_windows=block).collect()]
    want = [(str(i), 10 if t else 0, int(t == LEAK), ["1"] if t == LEAK else []) for i, t in rows]
    assert sorted(found) == sorted(want)
    kept = decontaminate.clean(docs, items, block_windows=block)
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str((i, t)) for i, t in rows if t != LEAK)
    assert kept.columns == docs.columns


def test_jaccard_links_of_blocks_and_of_rows_that_share_an_id(spark):
    import numpy as np

    one = np.arange(100, dtype=np.uint64)
    same = np.zeros(2, dtype=bool)
    assert not jaccard._linked([one, one[:99]], same, True, 0.8).any()  # the other block is empty
    assert jaccard._linked([one, one[:99]], same, False, 0.8).sum() == 2
    a, b = [" ".join(f"{x}{k}" for k in range(60)) for x in "ab"]
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end")]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    far = [(1, a), (5, b), (5, a + " end"), (9, b + " end")]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(spark.createDataFrame(far, DOCS)).collect())
    assert got == [(1, 1, 1), (5, 1, 1), (5, 5, 1), (9, 5, 1)]


@pytest.mark.parametrize("how", [{"block_elements": 150}])
def test_jaccard_counts_a_link_once_where_a_block_is_empty(spark, how):
    rows = [(3 * k + j, " ".join(f"g{k}w{i}" for i in range(80)) + " end" * j) for k in range(6) for j in range(3)]
    assert {r.n_links for r in jaccard.classes(spark.createDataFrame(rows, DOCS), **how).collect()} == {2}


def test_jaccard_keeps_a_row_that_shares_its_id_with_a_copy(spark):
    a, b = [" ".join(f"{x}{k}" for k in range(60)) for x in "ab"]
    docs = spark.createDataFrame([(1, a), (5, b), (5, a + " end"), (9, b + " end")], DOCS)
    assert sorted((r.doc_id, r.text) for r in jaccard.representatives(docs).collect()) == [(1, a), (5, b)]


@pytest.mark.parametrize("block", [200_000, 300])
def test_decontaminate_cuts_long_items_and_takes_items_without_an_id(spark, block):
    long = " ".join(f"q{k}" for k in range(500))
    items = spark.createDataFrame([(1, long), (None, OTHER), (3, long), (4, "")], "item_id long, text string")
    rows = [(1, " ".join(f"q{k}" for k in range(100, 200))), (2, OTHER), (3, None), (3, "q1 q2 q3"), (1, OTHER)]
    found = decontaminate.digest(decontaminate.overlaps(spark.createDataFrame(rows, DOCS), items, block_windows=block))
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in found.collect())
    assert got == [(1, 10, 10, 1), (1, 100, 100, 2), (2, 10, 10, 1), (3, 0, 0, 0), (3, 3, 0, 0)]
    blocks = list(decontaminate._blocks(items, 10, block))
    assert max(b.num_rows for b in blocks) <= 2 * block and sum(b.num_rows for b in blocks) == 2 * 491 + 1
