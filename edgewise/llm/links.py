"""Connected components over a table of links, without leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.session import release, stage


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that occurs in ``links`` (long a, long b).

    Alternates the large-star and small-star steps until each component is a star
    around its smallest node; each round is written to the shared folder. A hub's
    neighbours are only ever reduced by ``min`` or passed through a join that adaptive
    execution may split, so no group is gathered. Returns (node, root); self links and
    nulls are ignored; no links give no rows.
    """
    now = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        least = _both(now).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _both(now).join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = stage(small.where("a <> b").distinct(), "small-star")
        release(large, now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
