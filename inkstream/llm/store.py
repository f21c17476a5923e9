"""Shared plumbing: tables in the cluster's shared folder, Arrow batch sizes, checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow keys (tens of bytes each) up to which a side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="inkstream-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/inkstream-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is known to have few rows; as it is otherwise (a shuffled join)."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_type(docs: DataFrame) -> str:
    """The type of ``doc_id``: ids of any type are kept as they are."""
    return docs.schema["doc_id"].dataType.simpleString()


def release() -> None:
    """Delete what was written so far; for long sessions, once the results that were read from it are stored."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended
            return


atexit.register(release)
