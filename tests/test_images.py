"""The store of pictures: one file a digest, whatever is lost or repeated."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkstream.sources import images

ROWS = "url string, mime string, body binary"


def _gif(k, size=1000):
    return b"GIF89a" + bytes([k]) * size


def _pictures(path):
    return sorted(f for top, _, names in os.walk(path) for f in names if not top.rsplit("/", 1)[-1].startswith("_"))


def test_many_addresses_of_one_picture_are_one_file(spark, tmp_path):
    rows = [(f"u{k}", None, bytearray(_gif(k % 3))) for k in range(60)]
    rows += [("small", None, bytearray(_gif(1, 20))), ("page", "text/html", bytearray(b"x" * 2000)), ("by type", "image/AVIF; q=1", bytearray(b"x" * 2000)), ("none", "image/png", None), (None, None, bytearray(_gif(7)))]
    df = spark.createDataFrame(rows, ROWS).repartition(6)
    for jobs in (1, 2):
        images.store(df, f"{tmp_path}/s")
        got = images.stored(spark, f"{tmp_path}/s")
        assert got.count() == 62 * jobs and got.select("digest").distinct().count() == 5
        assert len(_pictures(f"{tmp_path}/s")) == 5
    held = {r.relpath: r.bytes for r in images.files(spark, f"{tmp_path}/s").collect()}
    assert held == {r.relpath: r.bytes for r in got.collect()} and {r.kind for r in got.collect()} == {"gif", "avif"}


def test_a_failed_job_is_not_listed_and_its_files_are_taken_on(spark, tmp_path):
    path = f"{tmp_path}/s"
    df = spark.createDataFrame([(f"u{k}", None, bytearray(_gif(k))) for k in range(20)], ROWS).repartition(4)
    broken = df.withColumn("url", F.when(F.col("url") == "u13", F.raise_error(F.lit("lost"))).otherwise(F.col("url")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        images.store(broken, path)
    assert images.stored(spark, path).count() == 0
    images.store(df, path)
    assert images.stored(spark, path).count() == 20 and len(_pictures(path)) == 20


def test_a_task_that_was_lost_and_one_that_ran_twice(tmp_path):
    path = str(tmp_path)
    rows = [Row(url=f"u{k}", digest=f"ab{k}", kind="gif", body=_gif(k)) for k in range(4)]

    def lost():
        yield from rows[:2]
        raise OSError("executor gone")

    writer = images.StoreWriter(path)
    with pytest.raises(OSError):
        writer.write(lost())
    a, b = writer.write(iter(rows)), writer.write(iter(rows))
    assert a.name != b.name
    writer.commit([b, None])
    assert _pictures(path) == [f"ab{k}.gif" for k in range(4)]
    assert (tmp_path / "_commits" / writer.job).read_text() == f'["{b.name}"]'
    writer.abort([a, None])
    assert not (tmp_path / "_lists" / a.name).exists() and (tmp_path / "_lists" / b.name).exists()
    with pytest.raises(ValueError):
        images.ImageStore({"path": path}).writer(None, True)


def test_query_agrees_with_sql(spark, twin):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        twin(entry.queries()["stored_images"](spark, sf), entry.oracle_sql()["stored_images"], sf)


def test_pictures_are_listed_by_tasks(spark, tmp_path):
    path = f"{tmp_path}/s"
    assert images.files(spark, path).count() == 0
    images.store(spark.createDataFrame([(f"u{k}", None, bytearray(_gif(k, 900 + k))) for k in range(40)], ROWS), path)
    folder = next(p for p in os.scandir(path) if len(p.name) == 2)
    (tmp_path / "s" / folder.name / ".half").write_bytes(b"x")
    got = images.files(spark, f"file://{path}")
    assert sorted(r.bytes for r in got.collect()) == [906 + k for k in range(40)]
    assert {r.relpath for r in got.collect()} == {r.relpath for r in images.stored(spark, path).collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Scan binaryFile" not in plan  # a scan's file names are gathered by the driver
