"""The pipeline's stages, and its whole run against the operators' brute-force twins."""

import corpus_pipeline
import pytest
from inkstream.llm import mixing, toxicity
from inkstream.llm.store import materialise
from pyspark.sql import functions as F

from .test_free import DOCS, brute_classes, brute_overlaps
from .test_native import brute_dedup

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.scored(docs, labels).where("predicted = 1").collect()}
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    left = {i: left[i] for i, keep, _, _ in brute_dedup(list(left.items())) if i == keep}
    left = {i: left[i] for i, (c, _) in brute_classes(list(left.items())).items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i for i, (_, n, _) in brute_overlaps(list(left.items()), items).items() if not n}
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.select("doc_id").collect()} == want
    assert got.columns == [*docs.columns, "mix_block", "mix_slot", "mix_seq"]


def test_stages_take_hard_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    hard = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text"))).withColumn("name", F.lit("x")).withColumn("slot", F.lit(1)).withColumn("place", F.lit(1))
    for rows in (hard, hard.limit(0), hard.union(hard)):
        out = rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, SF)
            assert out.columns[: len(rows.columns)] == rows.columns
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == rows.columns
        assert out.count() <= rows.count()


@pytest.mark.parametrize("kind", ["null", "text"])
def test_stages_take_rows_without_ids_and_ids_of_text(spark, kind):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")) if kind == "null" else F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    out = docs.withColumn("doc_id", own)
    for _, stage in corpus_pipeline.STAGES[1:]:
        out = materialise(stage(spark, out, SF))
    want = materialise(docs)
    for _, stage in corpus_pipeline.STAGES[1:]:
        want = materialise(stage(spark, want, SF))
    # Which of a group stays may differ, not how many do.
    texts = lambda df: {r.text for r in df.select("text").collect()}
    assert out.count() == want.count() and len(texts(out) ^ texts(want)) <= 0.1 * want.count()


def test_rows_without_an_id_have_places_of_their_own(spark):
    rows = [(k if k % 3 else None, f"text {k} " * 9, None, f"s{k % 4}", None) for k in range(900)] + [(7, "same id", None, f"s{k}", None) for k in range(4)]
    docs = spark.createDataFrame(rows, DOCS)
    planned = sorted((r.source, r.slot, r.seq) for r in mixing.plan(docs, {"s0": 3}, block_chars=500, bucket_rows=16).collect())
    mixed = mixing.mixed(docs, weights={"s0": 3}, block_chars=500, bucket_rows=16).collect()
    assert sorted((r.source, r.mix_slot, r.mix_seq) for r in mixed) == planned and len(set(planned)) == len(planned) == 904
    # Buckets stay small where a third of the ids are missing.
    own = docs.withColumn("h", F.xxhash64("doc_id", "text")).select("source", mixing._bucket("h", 64).alias("b"))
    assert own.groupBy("source", "b").count().agg(F.max("count")).first()[0] < 20
