"""What routes know about articles, kept: each batch adds its own states, and readers combine them.

States combine in any order and may be repeated (``merge.combined``), so a batch only appends, a batch that is run again
writes its own place anew, and one that came late or was written in part is never wrong, only incomplete until it is run again.
``compact`` writes the states of all batches so far as one table; readers take the last such table and the batches after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge

_SEQ = "struct<r:int,p:bigint>"
_TEXT = f"struct<seq:{_SEQ},x:string>"
STATE = {
    "guid": "string",
    "evidence": "array<string>",
    "url": _TEXT,
    "date": "struct<best:struct<k:int,r:int,p:bigint>,published_at:timestamp_ntz,date_confidence:string,date_precision:string>",
    "title": _TEXT,
    "html": _TEXT,
    "foreign": "boolean",
}


def written(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the tables ``kind``-N that were written whole."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at(path))] if fs.exists(at(path)) else []
    return sorted(int(n.removeprefix(f"{kind}-")) for n in names if n.startswith(f"{kind}-") and fs.exists(at(f"{path}/{n}/_SUCCESS")))


def add(rows: DataFrame, path: str, number: int) -> None:
    """Batch ``number`` (numbers only grow): ``rows`` as for ``merge.merge``.  Bytes written follow the batch."""
    state = merge.combined(merge.states(rows))
    state.select(*(F.col(c).cast(t).alias(c) for c, t in STATE.items())).write.mode("overwrite").parquet(f"{path}/batch-{number}")


def _places(spark: SparkSession, path: str, upto: int | None = None) -> list[str]:
    fits = lambda n: upto is None or n <= upto
    whole = max(filter(fits, written(spark, path, "whole")), default=None)
    after = [n for n in written(spark, path, "batch") if fits(n) and (whole is None or n > whole)]
    return [f"{path}/whole-{whole}"] * (whole is not None) + [f"{path}/batch-{n}" for n in after]


def read(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """One state a guid, of all batches or those up to a number; ``merge.merged`` turns it into rows.  Without batches it is empty."""
    schema = ", ".join(f"{c} {t}" for c, t in STATE.items())
    places = _places(spark, path, upto)
    return merge.combined(spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema))


def compact(spark: SparkSession, path: str) -> int | None:
    """All batches so far as one table, which takes the last one's number; null if there are none.  A batch at or before it that is run
    again with other rows is not seen any more."""
    number = max(written(spark, path, "batch"), default=None)
    if number is not None and number not in written(spark, path, "whole"):
        read(spark, path, number).write.mode("overwrite").parquet(f"{path}/whole-{number}")
    return number
