"""Snapshot streams: each new snapshot of the edges against the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.graph import EDGE, VERTEX, Meta, graph
from edgewise.operators.diff import edge_diff
from edgewise.session import read_table, release, stage


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def snapshot_edges(spark: SparkSession, out: str, number: int) -> DataFrame:
    """All edges of a snapshot that have arrived; none if none have. Failures to read them are failures."""
    path = f"{out}/edges/snapshot={number}"
    return spark.read.schema(EDGE).parquet(path) if _exists(spark, path) else spark.createDataFrame([], EDGE)


def diff_snapshots(stream: DataFrame, out: str, checkpoint: str):
    """A query over a stream of edges with a ``snapshot`` number that keeps the changes of each
    snapshot against the one numbered before it in ``out``/changes.

    The edges of a snapshot may arrive in any number of batches: each batch adds its own
    folder, and the changes of the snapshots it touches, and of those after them, are
    written anew from all edges so far. A batch that runs again writes the same folders, so
    a restart neither loses nor repeats changes. A snapshot is complete once the source says so.
    """
    spark = stream.sparkSession
    none = spark.createDataFrame([], VERTEX)

    def batch(df: DataFrame, number: int) -> None:
        df = stage(df, "snapshot-batch")
        touched = sorted(r.snapshot for r in df.select("snapshot").distinct().collect())
        for k in touched:
            df.where(F.col("snapshot") == k).select(*EDGE.names).write.mode("overwrite").parquet(f"{out}/edges/snapshot={k}/batch={number}")
        for k in sorted({*touched, *(k + 1 for k in touched if _exists(spark, f"{out}/edges/snapshot={k + 1}"))}):
            before, now = snapshot_edges(spark, out, k - 1), snapshot_edges(spark, out, k)
            changes = edge_diff(graph(none, before, Meta()), graph(none, now, Meta()))
            changes.withColumn("snapshot", F.lit(k)).write.mode("overwrite").parquet(f"{out}/changes/snapshot={k}")
        release(df)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()


def event_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) in tumbling windows; late ones count up to ``late``."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def read_events(spark, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")
