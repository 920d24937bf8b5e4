"""Reach sets that grow with a stream of edges: each batch searches only what its edges open up."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.operators.reach import discover, forget
from edgewise.streaming.snapshots import _exists


def _table(spark: SparkSession, path: str, columns: str, keys: str, buckets: int) -> str:
    """The name of a table at ``path``, a partition a batch in buckets by ``keys``; after a restart it takes up the files that are there."""
    name = "edgewise_" + hashlib.sha256(path.encode()).hexdigest()[:32]
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({columns}, batch BIGINT) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
        if _exists(spark, path):
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name


def _put(rows: DataFrame, table: str, number: int) -> None:
    """Write the partition of a batch; a batch that runs again takes the place of its first try."""
    rows.createOrReplaceTempView(view := f"{table}_rows")
    rows.sparkSession.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (batch = {number}) SELECT * FROM {view}")
    rows.sparkSession.catalog.dropTempView(view)


def reached(spark: SparkSession, out: str) -> DataFrame:
    """(key, id, batch) of all that the roots of :func:`grow_reach` reach so far."""
    return spark.read.schema("key int, id string, batch long").parquet(f"{out}/reached")


def grow_reach(stream: DataFrame, roots: DataFrame, out: str, checkpoint: str, buckets: int | None = None):
    """A query that keeps, under ``out``, what each key of ``roots`` (key int, id) reaches over all edges so far.

    ``stream`` has the edges (src, dst), in any order and any number of times; an end that is null
    makes no edge. A (key, id) goes out once, with the batch whose edges opened it up; roots
    go out with the first batch. A batch joins its own edges to what is reached, and searches on from
    there alone: neither the edges nor the reached rows of earlier batches move, for both lie
    in buckets, and none is written again. A late edge counts when it comes, since reach only grows.

    ``buckets`` (by default as many as shuffle partitions) must be the same for all runs over ``out``,
    and so must ``roots``. One query at a time may write to ``out``.
    """
    n = buckets or int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        edges = _table(spark, f"{out}/edges", "src STRING, dst STRING", "src", n)
        held = _table(spark, f"{out}/reached", "key INT, id STRING", "key, id", n)
        fresh = df.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
        _put(fresh.repartition(n, "src").dropDuplicates(["src", "dst"]), edges, number)
        known = spark.table(held).where(F.col("batch") < number).select("key", "id")
        come = spark.table(edges).where(F.col("batch") == number)
        opened = known.join(come, known.id == come.src).select("key", F.col("dst").alias("id"))
        start = opened.union(roots.select(F.col("key").cast("int"), "id")).distinct().join(known, ["key", "id"], "left_anti")
        pairs = spark.table(edges).where(F.col("batch") <= number).select("src", "dst")
        pairs._edgewise_index = True
        found = discover(pairs, start, ranked=False, known=known)
        _put(found.select("key", "id"), held, number)
        forget(found)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
