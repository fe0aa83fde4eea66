"""Work tables on shared storage: results that are read more than once are written, so a lost executor takes nothing with it."""

from __future__ import annotations

import functools
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "cohortlake-work"


def work_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; where that is unset, a temporary one of our own on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return _own_dir()
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


@functools.lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="cohortlake-")


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def work_path(spark: SparkSession, tag: str) -> str:
    """A fresh path on shared storage that is removed when the driver's JVM ends."""
    path = f"{work_dir(spark)}/{FOLDER}/{uuid.uuid4().hex}/{tag}"
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p.getParent())
    return path


def work_table(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to shared storage and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame, column: str) -> int:
    """About the bytes of a column: what Spark knows of the files, or else a sum over the rows."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return known if known < 1 << 60 else int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of work files."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def drop_work_table(df: DataFrame) -> None:
    """Remove the files of a work table that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/{FOLDER}/" in folder:
            drop_path(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more: it does so, in the background, when the driver collects garbage."""
    for _ in range(2):  # the first round frees what holds the plans
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
