"""Multi-root traversal: which other roots reach a vertex, how near, by which hop, on what evidence."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.functions.ids import abbreviated, utf16_key
from edgewise.graph import EDGE, Graph, dependencies
from edgewise.operators import supersteps
from edgewise.operators.queries import keyed, reverse
from edgewise.operators.reach import bucketed, forget, index
from edgewise.session import stage

MAX_DEPTH, MAX_REACHED, MAX_ROOTS, ROOTS_LISTED = 128, 100_000, 10_000, 64
#: The listed roots and whether there are more hang on one more; a root among them is left out of its own row, so
#: one more than that spreads.
DECISIVE = ROOTS_LISTED + 1
SPREAD = DECISIVE + 1


def mentions(spelling: Column, target: Column) -> Column:
    """Whether a type spelling names ``target`` as a whole; a cut spelling may name anything."""
    word = "A-Za-z0-9_\\u0080-\\U0010FFFF".replace("\\U0010FFFF", "\U0010ffff").replace("\\u0080", "\u0080")
    quoted = F.regexp_replace(target, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return abbreviated(spelling) | F.regexp_like(spelling, F.concat(F.lit(f"(?<![{word}./~-])"), quoted, F.lit(f"(?![{word}])")))


def member_edges(g: Graph) -> DataFrame:
    """Edges with type references moved to the field that names them.

    A references or signature edge of a type with a field list goes out from each field
    whose type names the target, unless one of its positions lies before the first field
    or the target has no package.
    """
    edges = dependencies(g)
    owners = g.vertices.where("kind = 'type' AND fields IS NOT NULL").select(F.col("id").alias("src"), F.explode("fields").alias("f"))
    owners = owners.select("src", F.substring_index("f", ":", 1).alias("field"), F.expr("substring(f, instr(f, ':') + 1)").alias("spelling"))
    fields = g.vertices.where("kind = 'field'").select(F.col("id").alias("fid"), F.col("name").alias("field"), F.regexp_replace("id", r"\.\(([^)]+)\)\.[^.]*$", ".$1").alias("src"), "position")
    first = fields.groupBy("src").agg(F.min("position").alias("first"))
    moved = edges.where("kind in ('references', 'signature')").join(first, "src").where(F.col("dst").contains("."))
    moved = moved.where(~F.coalesce(F.exists("positions", lambda p: (p["file"] == F.col("first.file")) & (p["line"] < F.col("first.line"))), F.lit(False)))
    moved = moved.join(owners, "src").where(mentions(F.col("spelling"), F.col("dst"))).join(fields.select("src", "field", "fid"), ["src", "field"])
    moved = stage(moved.select("src", "dst", "kind", "positions", "candidate", "fid"), "moved")
    kept = edges.join(moved.select("src", "dst", "kind").distinct(), ["src", "dst", "kind"], "left_anti").select(*EDGE.names)
    return kept.union(moved.select(F.col("fid").alias("src"), "dst", "kind", "positions", "candidate"))


def spread_roots(edges: DataFrame, start: DataFrame, depth: int) -> tuple[DataFrame, bool]:
    """How far the smallest roots of ``start`` (key, id) get along ``edges`` (src, dst; in buckets by src) in ``depth`` steps.

    A vertex holds roots with the level that brought them. A root that meets SPREAD smaller ones
    other than the vertex itself stops there: neither the listed roots of any vertex behind it
    nor the question what the depth cuts off can depend on it. So a vertex takes in SPREAD roots
    a level at most, however many there are.

    Returns (id, own, held), ``own`` the vertex's own place among the roots, and whether one more step would
    change the DECISIVE smallest roots of a vertex.
    """
    if supersteps.tasks(edges.sparkSession):
        held, _, cut = spread_all(edges, start, depth, False)
        return _held(held, start), cut
    held_type = "array<struct<root:int,level:int>>"
    first = start.select("id", F.col("key").alias("own"), F.array(F.struct(F.col("key").alias("root"), F.lit(0).alias("level"))).cast(held_type).alias("held"), F.array("key").alias("new"))
    state = bucketed(first, "roots_held", "id")
    others = F.transform(F.filter(F.coalesce("held", F.array().cast(held_type)), lambda h: ~h["root"].eqNullSafe(F.col("own"))), lambda h: h["root"])
    come = F.filter(F.coalesce("come", F.array().cast("array<int>")), lambda r: ~r.eqNullSafe(F.col("own")))
    for level in range(1, depth + 2):
        ahead = state.where(F.size("new") > 0).select(F.col("id").alias("src"), "new")
        arrived = edges.join(ahead, "src").select(F.col("dst").alias("id"), F.explode("new").alias("r")).groupBy("id").agg(F.collect_set("r").alias("come"))
        if level > depth:
            met = arrived.join(state, "id", "left").withColumn("others", others)
            late = F.exists(come, lambda r: ~F.array_contains("others", r) & (F.size(F.filter("others", lambda x: x < r)) < DECISIVE))
            return state, not met.where(late).isEmpty()
        met = arrived.join(state.drop("new"), "id", "full_outer").withColumn("others", others)
        new = F.array_except(F.slice(F.array_sort(F.array_union("others", come)), 1, SPREAD), "others")
        met = met.withColumn("new", new)
        held = F.concat(F.coalesce("held", F.array().cast(held_type)), F.transform("new", lambda r: F.struct(r.alias("root"), F.lit(level).alias("level"))))
        after = bucketed(met.select("id", "own", held.cast(held_type).alias("held"), "new"), "roots_held", "id")
        forget(state)
        state = after
        if state.where(F.size("new") > 0).isEmpty():
            return state, False


def spread_all(pairs: DataFrame, start: DataFrame, depth: int, grade: bool) -> tuple[DataFrame, DataFrame, bool]:
    """:func:`spread_roots` and, to ``grade``, :func:`unsure` as supersteps of one stage: (id, root, level), (id), and the depth flag."""
    pairs = pairs.where("src IS NOT NULL AND dst IS NOT NULL")
    start = start.where("id IS NOT NULL")
    ids = pairs.select(F.explode(F.array("src", "dst")).alias("id")).union(start.select("id"))
    for salt in itertools.count():
        v = lambda c: supersteps.number(F.col(c), salt)  # noqa: B023, E731
        mark = F.col("direct").cast("int") if grade else F.lit(0)
        links = supersteps.dealt(pairs.select(v("src").alias("v"), v("dst").alias("to"), mark.alias("mark")), start.select(v("id").alias("v"), "key", F.lit(0).alias("rank")))
        found = supersteps.run(links, supersteps.spread(depth, SPREAD, DECISIVE, grade), "v long, root int, level int, kind int", "spread")
        out = supersteps.named(found.where(F.col("kind") != supersteps.CUT), ids, salt)
        if out is not None:
            of = lambda kind: out.where(F.col("kind") == kind)  # noqa: B023, E731
            return of(supersteps.HELD).select("id", "root", "level"), of(supersteps.WEAK).select("id"), not found.where(F.col("kind") == supersteps.CUT).isEmpty()


def _held(rows: DataFrame, start: DataFrame) -> DataFrame:
    """(id, own, held) of rows (id, root, level)."""
    held = F.transform(F.array_sort(F.collect_list(F.struct("level", "root"))), lambda h: F.struct(h["root"].alias("root"), h["level"].alias("level")))
    return rows.groupBy("id").agg(held.alias("held")).join(start.select("id", F.col("key").alias("own")), "id", "left").select("id", "own", "held")


def unsure(pairs: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id) of the vertices that some root reaches within ``depth`` steps over all ``pairs`` (src, dst, direct; in buckets by src)
    but not over the direct ones. Roots are bits of 64-bit words, so all of them spread at once and exactly."""
    word = F.expr("CAST(key DIV 64 AS INT)").alias("w"), F.expr("shiftleft(1L, key % 64)").alias("new")
    first = start.select("id", *word).groupBy("id", "w").agg(F.bit_or("new").alias("new"))
    sides = first.select(F.explode(F.array(F.lit(False), F.lit(True))).alias("sure"), "id", "w", F.col("new").alias("have"), "new")
    state = bucketed(sides, "root_bits", "sure", "id", "w")
    for _ in range(depth):
        ahead = state.where("new <> 0").select("sure", F.col("id").alias("src"), "w", "new")
        come = pairs.join(ahead, "src").where("direct OR NOT sure").groupBy("sure", F.col("dst").alias("id"), "w").agg(F.bit_or("new").alias("come"))
        met = come.join(state.drop("new"), ["sure", "id", "w"], "full_outer").withColumns({"have": F.coalesce("have", F.lit(0)), "come": F.coalesce("come", F.lit(0))})
        after = bucketed(met.select("sure", "id", "w", F.col("have").bitwiseOR(F.col("come")).alias("have"), F.col("come").bitwiseAND(F.bitwise_not("have")).alias("new")), "root_bits", "sure", "id", "w")
        forget(state)
        state = after
        if state.where("new <> 0").isEmpty():
            break
    sure = state.where("sure").select("id", "w", F.col("have").alias("direct"))
    return state.where("NOT sure").join(sure, ["id", "w"], "left").where(~F.col("have").eqNullSafe(F.col("direct"))).select("id").distinct()


def _reached(state: DataFrame) -> DataFrame:
    """(id, depth, key, keys) of the vertices that another root reaches: the nearest one, of several the first, and all held, in order."""
    others = F.filter("held", lambda h: ~h["root"].eqNullSafe(F.col("own")))
    near = F.array_min(F.transform("others", lambda h: F.struct(h["level"].alias("depth"), h["root"].alias("key"))))
    out = state.withColumn("others", others).where(F.size("others") > 0)
    return out.select("id", near["depth"].alias("depth"), near["key"].alias("key"), F.array_sort(F.transform("others", lambda h: h["root"])).alias("keys"))


def traverse(g: Graph, roots: list[str], dependents: bool = False, depth: int = MAX_DEPTH, limit: int | None = MAX_REACHED, members: bool = False) -> tuple[DataFrame, list[str]]:
    """Rows (id, depth, via, roots, relationships, evidence, roots_truncated) and the truncation reasons.

    A row is a vertex that another root reaches within ``depth``: its distance to the
    nearest such root, the smallest predecessor (by UTF-16 units) on a shortest way from
    it, the kinds of that hop, and the roots in order, 64 at most. Evidence is direct if
    every root that reaches it also does over pairs with an edge that is no candidate. A root
    that is no vertex keeps its number and reaches nothing. Without a limit (None) all rows come.
    """
    if not 1 <= depth <= MAX_DEPTH or (limit is not None and not 1 <= limit <= MAX_REACHED) or len(roots) > MAX_ROOTS:
        raise ValueError("depth, limit or number of roots out of range")
    edges = member_edges(g) if members else dependencies(g)
    edges = reverse(edges.select("src", "dst", "kind", "candidate")) if dependents else edges.select("src", "dst", "kind", "candidate")
    pairs = edges.groupBy("src", "dst").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.bool_or(~F.col("candidate")).alias("direct"))
    start = keyed(g, roots)
    if supersteps.tasks(g.spark):
        pairs = stage(pairs, "traversal-pairs")
        grade = g.meta.dispatchEvidence and not pairs.where("NOT direct").isEmpty()
        held, weak, cut = spread_all(pairs, start, depth, grade)
        state = _held(held, start)
    else:
        pairs = bucketed(pairs.repartition("src"), "traversal_pairs", "src")
        state, cut = spread_roots(pairs.select("src", "dst"), start, depth)
        held = state.select("id", F.explode("held").alias("h")).select("id", "h.root", "h.level")
        weak = unsure(pairs.select("src", "dst", "direct"), start, depth) if g.meta.dispatchEvidence and not pairs.where("NOT direct").isEmpty() else held.select("id").limit(0)
    rows = stage(_reached(state), "reached-rows")
    before = held.select(F.col("id").alias("src"), F.col("root").alias("key"), (F.col("level") + 1).alias("depth"))
    hops = pairs.withColumnRenamed("dst", "id").join(rows.select("id", "depth", "key"), "id").join(before, ["src", "key", "depth"], "left_semi")
    via = hops.groupBy("id").agg(F.min_by(F.struct("src", "kinds"), utf16_key(F.col("src"))).alias("hop"))
    graded = rows.join(via, "id").join(weak.withColumn("weak", F.lit(True)), "id", "left")
    evidence = F.when(F.lit(g.meta.dispatchEvidence), F.when(F.col("weak"), "candidate").otherwise("direct"))
    out = graded.select(
        "id", "depth", F.col("hop.src").alias("via"), F.slice("keys", 1, ROOTS_LISTED).alias("roots"),
        F.col("hop.kinds").alias("relationships"), evidence.alias("evidence"), (F.size("keys") > ROOTS_LISTED).alias("roots_truncated"),
    )
    out = stage(out, "reached")
    reasons = ["depth"] if cut else []
    if limit is not None and out.limit(limit + 1).count() > limit:
        reasons.append("max-reached")
        out = out.orderBy("depth", utf16_key(F.col("id"))).limit(limit)
    return out, reasons


def narrowed(g: Graph, roots: list[str], dependents: bool = False, depth: int = MAX_DEPTH) -> int:
    """Vertices that all edges reach and member edges do not, of all that are reached."""

    def reached(edges: DataFrame) -> DataFrame:
        pairs = edges.select("src", "dst")
        state, _ = spread_roots(index(reverse(pairs) if dependents else pairs), keyed(g, roots), depth)
        return _reached(state).select("id")

    return reached(dependencies(g)).join(reached(member_edges(g)), "id", "left_anti").count()
