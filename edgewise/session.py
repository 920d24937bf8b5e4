"""Session helpers shared by every operator: tables, the shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; the path may belong to any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary
    folder of our own where a session on one machine leaves it unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="edgewise-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read, not a recomputation.
    The path is kept on the returned frame for :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/edgewise/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._edgewise_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what :func:`stage` wrote, once nothing lazy depends on it any more."""
    for df in frames:
        path = getattr(df, "_edgewise_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame, in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
