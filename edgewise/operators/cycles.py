"""Strongly connected components and their evidence.

Vertices without incoming or outgoing pairs are trimmed. A vertex with one way out, to a vertex
with one way in, is on a cycle exactly if that one is, so chains of such pairs become one
vertex by pointer doubling, and a ring is found whole. On what is left the smallest id spreads
forward to a fixed point, and from each vertex that kept its own id a backward search inside
its colour yields one component; repeat on the rest.
"""

from __future__ import annotations

import itertools
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.graph import Graph
from edgewise.operators import supersteps
from edgewise.operators.reach import discover
from edgewise.session import release, stage


def cycle_edges(g: Graph) -> DataFrame:
    """Edges that count for cycles: no ownership, no candidates."""
    return g.edges.where("kind <> 'contains' AND NOT candidate")


def _trim(pairs: DataFrame) -> DataFrame:
    """Pairs between vertices that have pairs in and out."""
    ends = pairs.select(F.col("src").alias("id")).intersect(pairs.select(F.col("dst").alias("id")))
    kept = pairs.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return stage(kept.select("src", "dst"), "trimmed")


def _chains(pairs: DataFrame) -> DataFrame:
    """(id, head, ring): vertices of chains, and the vertex that stands for each chain: its last one, of a ring the smallest."""
    one_out = pairs.groupBy("src").agg(F.min("dst").alias("dst"), F.count("*").alias("n")).where("n = 1").select("src", "dst")
    one_in = pairs.groupBy("dst").agg(F.count("*").alias("n")).where("n = 1").select("dst")
    now = one_out.join(one_in, "dst", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("on"), F.least("src", "dst").alias("least"), F.lit(False).alias("ended"))
    now = stage(now, "chains")
    n = now.count()
    # After as many doublings as n has bits, what has not ended goes round a ring.
    for _ in range(int(log2(n)) + 1 if n else 0):
        over = now.select(F.col("id").alias("on"), F.col("on").alias("over"), F.col("least").alias("_l"), F.col("ended").alias("_e"))
        then = now.join(over, "on", "left")
        after = stage(then.select("id", F.coalesce("over", "on").alias("on"), F.least("least", F.coalesce("_l", "least")).alias("least"), (F.col("over").isNull() | F.col("_e")).alias("ended")), "chains")
        release(now)
        now = after
        if now.where("NOT ended").isEmpty():
            break
    return now.select("id", F.when(F.col("ended"), F.col("on")).otherwise(F.col("least")).alias("head"), (~F.col("ended")).alias("ring"))


def _spread(pairs: DataFrame) -> DataFrame:
    """(id, colour): the smallest id with a path to each vertex, itself included. Only vertices whose colour fell offer it on."""
    ids = pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct()
    now = stage(ids.select("id", F.col("id").alias("colour"), F.lit(True).alias("new")), "colours")
    while True:
        offered = pairs.join(now.where("new").select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("c"))
        after = stage(now.join(offered, "id", "left").select("id", F.least("colour", F.coalesce("c", "colour")).alias("colour"), F.coalesce(F.col("c") < F.col("colour"), F.lit(False)).alias("new")), "colours")
        release(now)
        now = after
        if now.where("new").isEmpty():
            return now.select("id", "colour")


def _cores(pairs: DataFrame) -> DataFrame:
    """(component, id) of the vertices of ``pairs`` on cycles, no loops among them, as supersteps of one stage."""
    ids = pairs.select(F.explode(F.array("src", "dst")).alias("id"))
    for salt in itertools.count():
        v = lambda c: supersteps.number(F.col(c), salt)  # noqa: B023, E731
        ways = [pairs.select(v(a).alias("v"), v(b).alias("to"), F.lit(k).alias("mark")) for k, (a, b) in enumerate((("src", "dst"), ("dst", "src")))]
        none = ids.select(v("id").alias("v"), F.lit(0).alias("key"), F.lit(0).alias("rank")).limit(0)
        found = supersteps.run(supersteps.dealt(ways[0].union(ways[1]), none), supersteps.cores(), "v long, colour long", "cores")
        out = supersteps.named(found, ids, salt)
        if out is not None:
            many = out.groupBy("colour").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
            return stage(out.join(many, "colour").select("component", "id"), "components")


def components(pairs: DataFrame) -> DataFrame:
    """(component, id) of all vertices on a cycle of ``pairs`` (src, dst); the component is its smallest member."""
    pairs = pairs.select("src", "dst").distinct()
    rest = stage(pairs.where("src <> dst"), "pairs")
    # What was learnt, in order: vertices on a cycle of their own, vertices that stand for others, components.
    learnt = [("loops", stage(pairs.where("src = dst").select(F.col("src").alias("id")), "loops"))]
    size = rest.count()
    while size:
        before = None
        # Trimming and contraction feed each other; supersteps trim by themselves, so they take over where these gain little.
        while size and (before is None or size < (0.5 * before if supersteps.tasks(pairs.sparkSession) else before)):
            trimmed, before = _trim(rest), size
            release(rest)
            chains = stage(_chains(trimmed), "heads")
            rest, loops = _contract(trimmed, chains)
            learnt += [("heads", chains), ("loops", loops)]
            size = rest.count()
        if not size:
            break
        if supersteps.tasks(pairs.sparkSession):
            learnt.append(("components", _cores(rest)))
            break
        colours = _spread(rest)
        inside = rest.join(colours.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        # Backward from each colour's own vertex; pairs inside colours do not leave them.
        back = discover(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colours.where("id = colour").select(F.lit(0).alias("key"), "id"), ranked=False).select("id")
        found = stage(colours.join(back, "id", "left_semi").select(F.col("colour").alias("component"), "id"), "components")
        many = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        learnt.append(("components", found.join(many, "component", "left_semi").select("component", "id")))
        gone = found.select("id")
        left = stage(rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "rest")
        release(rest)
        rest, size = left, left.count()
    return _unfold(learnt)


def _contract(pairs: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs between heads, and the heads (id) of rings and of chains that close."""
    on = chains.select(F.col("id").alias("dst"), "head")
    kept = pairs.join(chains.select(F.col("id").alias("src")), "src", "left_anti").join(on, "dst", "left").select("src", F.coalesce("head", "dst").alias("dst"))
    kept = stage(kept.distinct(), "contracted")
    loops = kept.where("src = dst").select(F.col("src").alias("id")).union(chains.where("ring").select("head").distinct())
    return kept.where("src <> dst"), loops


def _unfold(learnt: list) -> DataFrame:
    """Members of all components, from what was learnt last to what was first: a vertex belongs where its head does, or to
    itself if nothing larger claims it."""
    members = None
    for kind, x in reversed(learnt):
        if members is None:
            members = x.select(F.lit("").alias("component"), "id").limit(0)
        if kind == "components":
            more = x
        elif kind == "heads":
            more = x.where("id <> head").join(members.withColumnRenamed("id", "head"), "head").select("component", "id")
        else:
            more = x.join(members, "id", "left_anti").select(F.col("id").alias("component"), "id")
        if not more.isEmpty():
            members = stage(members.union(more.select("component", "id")), "members")
    first = members.groupBy("component").agg(F.min("id").alias("first"))
    return members.join(first, "component").select(F.col("first").alias("component"), "id")


def cycles(g: Graph) -> DataFrame:
    """(component, id): members of every cycle; the component is its smallest member."""
    return stage(components(cycle_edges(g)), "components")


def evidence(g: Graph, members: DataFrame) -> DataFrame:
    """(component, src, dst, kind, position): the relations inside each cycle, once each, with their first position."""
    a = members.select(F.col("id").alias("src"), "component")
    b = members.select(F.col("id").alias("dst"), F.col("component").alias("_c"))
    inside = cycle_edges(g).join(a, "src").join(b, "dst").where("component = _c")
    return inside.groupBy("component", "src", "dst", "kind").agg(F.min(F.array_min("positions")).alias("position"))
