import os
import sys
import tempfile

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Rows of a query and of its SQL on the same tables, in one order."""
    import duckdb

    def run(name, query, sql, sf_dir="/root/testdata/sf0.001"):
        con = duckdb.connect()
        for t in os.listdir(sf_dir):
            con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
        df, rel = query(spark, sf_dir), con.sql(sql)
        cols = list(rel.columns)
        assert sorted(df.columns) == sorted(cols), name
        key = lambda r: tuple(map(str, r))
        mine = sorted((tuple(r[c] for c in sorted(cols)) for r in df.collect()), key=key)
        theirs = sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in rel.fetchall()), key=key)
        return mine, theirs

    return run
