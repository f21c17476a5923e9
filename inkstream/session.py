"""What a Spark session needs before Python code of this package can run on its executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once for each application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    folder = tempfile.mkdtemp()  # read by the driver's own file server
    target = os.path.join(folder, f"{top.name}_package.zip")
    Path(target).write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def configure(spark: SparkSession) -> None:
    """Timestamps without zones, UTC, and small Arrow batches: Python workers then need little memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; a temporary one only on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(top or tempfile.mkdtemp(prefix='inkstream-')).rstrip('/')}/inkstream-{uuid.uuid4().hex}"
