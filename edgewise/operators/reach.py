"""Breadth-first search: distances from keyed roots, discovery order, and the index it runs on.

A search of its own runs its levels as supersteps of one barrier stage (``supersteps``). One that goes on
from what is known already, as in a stream, or where Spark allows no barrier stage, goes level by level:
the driver loops over levels, executors do the work. The distinct pairs are an :func:`index`,
a table in buckets by source, which no level moves: the frontier goes to the edges. What a
level finds is grouped by (key, id), taken off by what the levels before it found, and
appended to one table, a partition a level in buckets by (key, id), so neither the new rows
nor the seen ones move again. All levels have one plan, down to its literals, so its code
is compiled once. The lineage stays flat, and a lost executor costs one level.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from edgewise.operators import supersteps
from edgewise.session import shared_dir, stage

#: Fixpoints keep so many rounds as tables of their own before they are merged.
LEVELS = 12


def bucketed(df: DataFrame, name: str, *keys: str, sort: bool = True) -> DataFrame:
    """``df`` as a table in the shared folder, in as many buckets by ``keys`` as there are shuffle partitions."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"edgewise_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/edgewise/{table}"
    writer = df.write.bucketBy(n, *keys)
    (writer.sortBy(*keys) if sort else writer).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._edgewise_path, out._edgewise_table = path, table
    return out


def index(pairs: DataFrame) -> DataFrame:
    """The distinct (src, dst) of ``pairs``, in buckets by src; searches take it as it is, any number of them."""
    if getattr(pairs, "_edgewise_index", False):
        return pairs
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = bucketed(pairs.select("src", "dst").repartition(n, "src").dropDuplicates(["src", "dst"]), "pairs", "src")
    out._edgewise_index = True
    return out


def forget(*tables: DataFrame) -> None:
    """Drop tables of :func:`bucketed` once nothing lazy needs them; their files go with :func:`edgewise.session.release`."""
    from edgewise.session import release

    for t in tables:
        if getattr(t, "_edgewise_table", None):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._edgewise_table}")
    release(*tables)


def _union(tables: list) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.union(x)
    return out


def step(edges: DataFrame, now: DataFrame) -> DataFrame:
    """What the frontier ``now`` (key, id, depth, rank) offers along an index: (key, id, depth, by), ``by`` the least (rank, parent)."""
    ahead = now.select("key", F.col("id").alias("src"), "depth", "rank")
    met = edges.join(ahead, "src").select("key", F.col("dst").alias("id"), (F.col("depth") + 1).alias("depth"), F.struct("rank", F.col("src").alias("parent")).alias("by"))
    return met.groupBy("key", "id").agg(F.min("depth").alias("depth"), F.min("by").alias("by"))


class _Levels:
    """The rows found so far: one table, a partition a level, each in buckets by (key, id)."""

    def __init__(self, spark):
        self.spark, self.n = spark, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"edgewise_levels_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark)}/edgewise/{self.table}"

    def append(self, rows: DataFrame) -> int:
        """Write a level; returns how many rows it has."""
        seen = Observation()
        rows = rows.select("key", "id", "parent", "rank", "depth").observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.partitionBy("depth").bucketBy(self.n, "key", "id").option("path", self.path).format("parquet").mode("append").saveAsTable(self.table)
        return seen.get["n"]

    def rows(self) -> DataFrame:
        out = self.spark.table(self.table).select("key", "id", "depth", "parent", "rank")
        out._edgewise_path, out._edgewise_table = self.path, self.table
        return out


def discover(pairs: DataFrame, roots: DataFrame, depth: int | None = None, ranked: bool = True, known: DataFrame | None = None, parents: bool = True) -> DataFrame:
    """Breadth-first search along ``pairs`` (src, dst), or an :func:`index` of them, from ``roots`` (key, id).

    Returns key, id, depth, parent and rank. Of one key, (depth, rank) is the discovery order: roots by
    id, then by the parent's place and the id; ranks have gaps. The parent is the first
    discoverer, unranked the smallest one, and the rank is null then; unranked and without ``parents``
    that is null too, and ids need no order. The search does not enter what is ``known`` (key, id), and
    does not return it. ``pairs`` are read twice.
    """
    if known is None and supersteps.tasks(pairs.sparkSession):
        return _by_order(pairs, roots, depth, ranked) if ranked or parents else _by_hash(pairs, roots, depth)
    return _by_levels(pairs, roots, depth, ranked, known)


_FOUND = "key long, v long, depth int, parent long, rank long"


def _ends(pairs: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs with both ends, roots, and all their ids, with repeats."""
    pairs = pairs.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    roots = roots.select("key", "id").where("id IS NOT NULL").distinct()
    return pairs, roots, pairs.select(F.explode(F.array("src", "dst")).alias("id")).union(roots.select("id"))


def _by_hash(pairs: DataFrame, roots: DataFrame, depth: int | None) -> DataFrame:
    """An unranked search without parents, over hashes of ids; where two ids share a hash that was found, once more over others."""
    kind = roots.schema["key"].dataType
    pairs, roots, ids = _ends(pairs, roots)
    for salt in itertools.count():
        v = lambda c: supersteps.number(F.col(c), salt)  # noqa: B023, E731
        links = supersteps.dealt(pairs.select(v("src").alias("v"), v("dst").alias("to"), F.lit(0).alias("mark")), roots.select(v("id").alias("v"), "key", F.lit(0).alias("rank")))
        found = supersteps.run(links, supersteps.search(depth, False, False, 0), _FOUND, "search")
        out = supersteps.named(found.select("v", F.col("key").cast(kind).alias("key"), "depth"), ids, salt)
        if out is not None:
            return out.select("key", "id", "depth", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("rank"))


def _by_order(pairs: DataFrame, roots: DataFrame, depth: int | None, ranked: bool) -> DataFrame:
    """A search over numbers that are in the order of the ids, by a global sort."""
    kind, n = roots.schema["key"].dataType, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs, roots, ids = _ends(pairs, roots)
    place = F.monotonically_increasing_id()
    numbers = stage(ids.distinct().repartitionByRange(n, "id").sortWithinPartitions("id").select("id", place.alias("v")), "numbers")
    of = lambda id, v: numbers.select(F.col("id").alias(id), F.col("v").alias(v))
    starts = roots.join(numbers, "id").select("v", "key")
    if ranked:
        starts = starts.repartitionByRange(n, "key", "v").sortWithinPartitions("key", "v")
    starts = starts.select("v", "key", (place if ranked else F.lit(0)).alias("rank"))
    links = supersteps.dealt(pairs.join(of("src", "v"), "src").join(of("dst", "to"), "dst").select("v", "to", F.lit(0).alias("mark")), starts)
    found = supersteps.run(links, supersteps.search(depth, ranked, True, n << 33), _FOUND, "search")
    out = found.join(numbers, "v").join(of("_parent", "parent"), "parent", "left")
    rank = F.col("rank") if ranked else F.lit(None).cast("long")
    return stage(out.select(F.col("key").cast(kind).alias("key"), "id", "depth", F.col("_parent").alias("parent"), rank.alias("rank")), "found")


def _by_levels(pairs: DataFrame, roots: DataFrame, depth: int | None, ranked: bool, known: DataFrame | None) -> DataFrame:
    """The search level by level, as appended tables."""
    edges, held = index(pairs), _Levels(pairs.sparkSession)
    now = roots.select("key", "id").distinct().withColumns({"depth": F.lit(0), "parent": F.lit(None).cast("string"), "_by": F.lit(None).cast("long")})
    level = 0
    while True:
        rank = F.lit(None).cast("long")
        if ranked:  # a global sort numbers the level; no task holds all of it
            now, rank = now.repartitionByRange("key", "_by", "id").sortWithinPartitions("key", "_by", "id"), F.monotonically_increasing_id()
        now = now.withColumn("rank", rank)
        new = held.append(now.repartition(held.n, "key", "id") if ranked else now)
        if new == 0 or level == depth:
            return held.rows()
        seen = held.rows()
        found = step(edges, seen.where(F.col("depth") == level)).join(seen.select("key", "id"), ["key", "id"], "left_anti")
        if known is not None:
            found = found.join(known.select("key", "id"), ["key", "id"], "left_anti")
        now = found.select("key", "id", "depth", F.col("by.parent").alias("parent"), F.col("by.rank").alias("_by"))
        level += 1


def reachable(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of all that ``roots`` (id) reach, themselves included."""
    return discover(pairs, roots.select(F.lit(0).alias("key"), "id"), ranked=False, parents=False).select("id")


def ancestors(found: DataFrame, targets: DataFrame) -> DataFrame:
    """(n, id, depth): the discovery paths to ``targets`` (n, key, id) of a search ``found``, ends included.

    Parent pointers are doubled, so the joins are as many as the longest path is long in bits.
    """
    hops = stage(found.select("key", "id", "parent", "depth"), "parents")
    jump = hops.select("key", "id", F.col("parent").alias("up"))
    on = targets.select("n", "key", "id").join(hops.select("key", "id"), ["key", "id"], "left_semi").select("n", "key", "id")
    most = targets.join(hops, ["key", "id"]).agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    reach = 1
    while reach <= most:
        up = on.join(jump, ["key", "id"]).where("up is not null").select("n", "key", F.col("up").alias("id"))
        on = stage(on.union(up).distinct(), "ancestors")
        reach *= 2
        if reach <= most:
            over = jump.select("key", F.col("id").alias("up"), F.col("up").alias("over"))
            jump = stage(jump.join(over, ["key", "up"], "left").select("key", "id", F.col("over").alias("up")), "jumps")
    return on.join(hops, ["key", "id"]).select("n", "id", "depth")


def backtrack(found: DataFrame, target: str) -> DataFrame:
    """(step, id): the discovery path to ``target`` of a search of one key, root first; empty if it was not found."""
    goal = found.where(F.col("id") == target).select(F.lit(0).alias("n"), "key", "id")
    return ancestors(found, goal).select(F.col("depth").alias("step"), "id").distinct().orderBy("step")
