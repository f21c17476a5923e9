import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYTHONHASHSEED", "0")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.timestampType", "TIMESTAMP_NTZ")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from inkstream.session import configure

    configure(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def twin():
    """Compare a DataFrame with SQL over the same tables in another engine."""

    def compare(df, sql, sf="/root/testdata/sf0.001"):
        import duckdb

        con = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        a, b = df.toArrow(), con.sql(sql).to_arrow_table()
        names = sorted(a.column_names)
        assert names == sorted(b.column_names)
        rows = lambda t: sorted(repr(tuple(str(r[k]) for k in names)) for r in t.to_pylist())
        assert rows(a) == rows(b)

    return compare
