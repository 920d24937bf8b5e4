"""Point queries over a graph: neighbours, impact, paths, shared dependencies, reachability, dead symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.functions.ids import COLLISION, member_owner
from edgewise.graph import Graph, dependencies, live_roots, neighbors, symbols
from edgewise.operators.reach import backtrack, discover, reachable
from edgewise.session import stage


class NotFound(ValueError):
    """A vertex that a query names is not in the document; the text may hint at the level."""


def _need(g: Graph, *ids: str) -> None:
    have = {r.id for r in g.vertices.where(F.col("id").isin(list(ids))).select("id").collect()}
    for id in ids:
        if id not in have:
            hint = "; the document is empty" if g.vertices.isEmpty() else f"; the document has the {g.meta.level} level" if g.meta.level != "symbol" else ""
            raise NotFound(f"vertex not found: {id}{hint}")


def keyed(g: Graph, ids: list[str]) -> DataFrame:
    return g.spark.createDataFrame(list(enumerate(ids)), "key int, id string")


def reverse(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in pairs.columns if c not in ("src", "dst")))


def walk(pairs: DataFrame, root: DataFrame, depth: int, limit: int = 0) -> DataFrame:
    """Neighbours in one direction: (id, kinds, depth, rank) with the kinds of the discovering pair."""
    found = discover(pairs, root, max(1, depth), ranked=depth > 1 or limit > 0).where("depth > 0")
    if limit > 0:
        found = found.orderBy("depth", "rank").limit(limit)
    return found.join(pairs, (pairs.src == found.parent) & (pairs.dst == found.id)).select("id", "kinds", "depth", "rank")


def query(g: Graph, id: str, depth: int = 1, limit: int = 0) -> DataFrame:
    """(direction, id, kinds, depth): what ``id`` depends on and is depended on by, to a depth of at least 1.

    A limit takes the first in discovery order of each direction; rows can be sorted by id at the sink.
    """
    _need(g, id)
    pairs, root = stage(neighbors(g), "neighbors"), keyed(g, [id])
    on = walk(pairs, root, depth, limit).withColumn("direction", F.lit("dependsOn"))
    by = walk(reverse(pairs), root, depth, limit).withColumn("direction", F.lit("dependedBy"))
    return on.union(by).select("direction", "id", "kinds", "depth")


def _layers(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs that lead from one layer to the next: (id, depth, parent, kinds)."""
    a, b = found.select(F.col("id").alias("src"), F.col("depth").alias("_d")), found.select(F.col("id").alias("dst"), "depth", "rank")
    return pairs.join(a, "src").join(b, "dst").where("depth = _d + 1").select(F.col("dst").alias("id"), "depth", "rank", F.col("src").alias("parent"), "kinds")


def impact(g: Graph, ids: list[str], depth: int = 0, limit: int = 0) -> DataFrame:
    """(id, depth, kinds) of all that depends on ``ids``, with the kinds of all pairs from the layer before."""
    _need(g, *ids)
    pairs = stage(reverse(neighbors(g)), "dependers")
    roots = keyed(g, ids).select(F.lit(0).alias("key"), "id").distinct()
    found = discover(pairs, roots, depth if depth > 0 else None, ranked=limit > 0, parents=False)
    out = _layers(pairs, found)
    if limit > 0:
        out = out.join(found.where("depth > 0").orderBy("depth", "rank").limit(limit).select("id"), "id", "left_semi")
    return out.groupBy("id", "depth").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))


def depth_limited(g: Graph, ids: list[str], depth: int) -> bool:
    """Whether the layer at ``depth`` has dependers that were not reached."""
    found = discover(reverse(neighbors(g)), keyed(g, ids).select(F.lit(0).alias("key"), "id"), depth + 1, ranked=False, parents=False)
    return depth > 0 and not found.where(F.col("depth") == depth + 1).isEmpty()


def path(g: Graph, src: str, dst: str) -> DataFrame:
    """(step, id, kinds): the shortest path, first by id order; kinds are those of the pair that leads to
    the step. From a vertex to itself is one step; empty if there is none."""
    _need(g, src, dst)
    pairs = stage(neighbors(g), "neighbors")
    if src == dst:
        return g.spark.createDataFrame([(0, src, None)], "step int, id string, kinds array<string>")
    steps = backtrack(discover(pairs, keyed(g, [src])), dst)
    before = steps.select((F.col("step") + 1).alias("step"), F.col("id").alias("src"))
    out = steps.join(before, "step", "left")
    return out.join(pairs.withColumnRenamed("src", "_s"), (F.col("_s") == F.col("src")) & (F.col("dst") == F.col("id")), "left").select("step", "id", "kinds").orderBy("step")


def shared(g: Graph, ids: list[str]) -> DataFrame:
    """(id, roots, n): which of ``ids`` reach each vertex, themselves included, over dependencies.

    Shared are those with n = len(ids); only[r] are those that r reaches and not all do.
    """
    _need(g, *ids)
    found = discover(dependencies(g), keyed(g, ids), ranked=False, parents=False)
    return found.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("roots"), F.count("*").alias("n"))


def reach_pairs(g: Graph) -> DataFrame:
    """Dependency pairs and the steps from a receiver to methods that outside interfaces may call."""
    ids = g.vertices.select(F.col("id").alias("src")).distinct()
    hops = g.vertices.where("kind = 'method' AND satisfies IS NOT NULL").select(F.col("receiver").alias("src"), F.col("id").alias("dst"))
    return dependencies(g).select("src", "dst").union(hops.join(ids, "src", "left_semi").select("src", "dst")).distinct()


def external_hops(g: Graph) -> DataFrame:
    """(src, dst, satisfies): steps of :func:`reach_pairs` that no dependency edge makes."""
    hops = g.vertices.where("kind = 'method' AND satisfies IS NOT NULL").select(F.col("receiver").alias("src"), F.col("id").alias("dst"), "satisfies")
    return hops.join(dependencies(g).select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def retention_roots(g: Graph, public: bool = False, extra: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """Roots (id), and the extra ones that are no vertices."""
    roots = live_roots(g)
    if public:
        roots = roots.union(symbols(g).where("exported").select("id"))
    if extra:
        asked = g.spark.createDataFrame([(x,) for x in extra], "id string")
        ids = g.vertices.select("id").distinct()
        roots = roots.union(asked.join(ids, "id", "left_semi"))
        return roots.distinct(), sorted(r.id for r in asked.join(ids, "id", "left_anti").collect())
    return roots.distinct(), []


FINDING = ["id", "kind", "package", "position", "exported", "generated", "satisfies", "tagKeys"]


def dead(g: Graph, reached: DataFrame) -> DataFrame:
    """Symbols that are not in ``reached`` (id), as findings."""
    out = symbols(g).join(reached.select("id").distinct(), "id", "left_anti")
    return out.select(*FINDING, F.lit("unreachable").alias("state"), F.lit("not reachable from retention roots").alias("reason"))


def unreachable(g: Graph, public: bool = False, extra: list[str] = ()) -> DataFrame:
    roots, _ = retention_roots(g, public, extra)
    return dead(g, reachable(reach_pairs(g), roots))


def abstract_methods(g: Graph) -> DataFrame:
    """(id) of interface methods, by the owner in their id, with or without the collision mark."""
    v = g.vertices
    owners = v.select("id", "kind", "interface")
    members = v.select(F.col("id").alias("member"), member_owner(F.col("id")).alias("owner")).where("owner is not null")
    plain = owners.select(F.col("id").alias("owner"), F.col("kind").alias("pk"), F.col("interface").alias("pi"))
    marked = owners.where(F.col("id").endswith(COLLISION)).select(F.expr(f"left(id, length(id) - {len(COLLISION)})").alias("owner"), F.col("interface").alias("mi"))
    joined = members.join(plain, "owner", "left").join(marked, "owner", "left")
    yes = F.when(F.col("pk") == "type", F.col("pi")).otherwise(F.coalesce("mi", F.lit(False)))
    return joined.where(yes).select(F.col("member").alias("id")).distinct()


def abstract_calls(g: Graph, graph_reach: DataFrame, rta_reach: DataFrame) -> DataFrame:
    """Pairs from live callers to interface methods."""
    calls = g.edges.where("kind in ('call', 'references')").join(abstract_methods(g).select(F.col("id").alias("dst")), "dst", "left_semi")
    kinds = g.vertices.select(F.col("id").alias("src"), F.col("kind").alias("vk"))
    rta = rta_reach.select(F.col("id").alias("src"), F.lit(True).alias("r")).distinct()
    graph_ = graph_reach.select(F.col("id").alias("src"), F.lit(True).alias("q")).distinct()
    joined = calls.join(kinds, "src", "left").join(rta, "src", "left").join(graph_, "src", "left")
    live = F.coalesce("r", F.lit(False)) | (~F.coalesce(F.col("vk").isin("func", "method"), F.lit(False)) & F.coalesce("q", F.lit(False)))
    return joined.where(live).select("src", "dst").distinct()


def dead_rta(g: Graph, graph_reach: DataFrame, rta_reach: DataFrame) -> DataFrame:
    """Findings under rapid type analysis: callables by ``rta_reach``, interface methods by live callers, the rest by the graph."""
    mark = lambda df, name: df.select("id", F.lit(True).alias(name)).distinct()
    used = abstract_calls(g, graph_reach, rta_reach).select(F.col("dst").alias("id"))
    s = symbols(g).join(mark(rta_reach, "_r"), "id", "left").join(mark(graph_reach, "_g"), "id", "left").join(mark(abstract_methods(g), "_a"), "id", "left").join(mark(used, "_u"), "id", "left")
    callable_ = F.col("kind").isin("func", "method")
    gone = F.when(callable_ & F.col("_a").isNotNull(), F.col("_u").isNull() & F.col("_r").isNull()).when(callable_, F.col("_r").isNull()).otherwise(F.col("_g").isNull())
    reason = F.when(callable_, "not reachable under rapid type analysis").otherwise("not reachable from retention roots")
    return s.where(gone).select(*FINDING, F.lit("unreachable").alias("state"), reason.alias("reason"))


def explain(g: Graph, id: str, roots: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(step, id): why ``id`` is reached; empty if it is not. ``pairs`` may be those of another call graph."""
    _need(g, id)
    found = discover(reach_pairs(g) if pairs is None else pairs, roots.select(F.lit(0).alias("key"), "id"))
    return backtrack(found, id)


def vertices_of_files(g: Graph, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id) of ``files`` (file): declared there, or packages of its folder; and the unmapped files.

    Files are relative to the document's root; only source files map.
    """
    root = g.meta.root.rstrip("/")
    rel = lambda c: F.when(c.startswith(root + "/"), F.substring(c, len(root) + 2, 1 << 30)).otherwise(c) if root else c
    folder = lambda c: F.when(c.contains("/"), F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit("."))
    asked = files.select("file").distinct().withColumn("_f", rel(F.col("file"))).where(F.col("_f").endswith(".go"))
    at = g.vertices.where("position is not null").select("id", "package", rel(F.col("position.file")).alias("_f"))
    direct = asked.join(at, "_f").select("file", "id")
    packages = at.select(folder(F.col("_f")).alias("_d"), F.col("package").alias("id")).where("id is not null").distinct()
    packages = packages.join(g.vertices.where("kind = 'package'").select("id"), "id", "left_semi")
    by_folder = asked.withColumn("_d", folder(F.col("_f"))).join(packages, "_d").select("file", "id")
    mapped = direct.union(by_folder).distinct()
    return mapped.select("id").distinct(), files.select("file").distinct().join(mapped.select("file").distinct(), "file", "left_anti")


def affected_by_files(g: Graph, files: DataFrame, extra: list[str] = (), depth: int = 0, limit: int = 0) -> DataFrame:
    """:func:`impact` of the vertices of ``files`` and of ``extra``."""
    roots = [r.id for r in vertices_of_files(g, files)[0].orderBy("id").collect()]
    return impact(g, sorted({*roots, *extra}), depth, limit) if roots or extra else g.spark.createDataFrame([], "id string, depth int, kinds array<string>")


TEST_NAME = "^(Test|Example|Fuzz|Benchmark)"


def change_candidates(g: Graph, files: DataFrame, depth: int = 0, limit: int = 0) -> DataFrame:
    """(id, kind, depth, via, edges, reason, test_candidate): what a change of ``files`` may touch, roots included."""
    roots = vertices_of_files(g, files)[0]
    ids = g.vertices.select("id").distinct()
    pairs = neighbors(g).join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    pairs = stage(reverse(pairs), "dependers")
    found = discover(pairs, roots.select(F.lit(0).alias("key"), "id"), depth if depth > 0 else None, ranked=False, parents=False)
    via = _layers(pairs, found).groupBy("id").agg(F.array_sort(F.collect_set("parent")).alias("via"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("edges"))
    v = g.vertices.select("id", "kind", "name", "position").dropDuplicates(["id"])
    out = found.select("id", "depth").join(via, "id", "left").join(v, "id")
    test = F.coalesce(F.col("position.file").endswith("_test.go") & (F.col("kind") == "func") & F.col("name").rlike(TEST_NAME), F.lit(False))
    reason = F.when(F.col("depth") == 0, "changed-file declaration or package").otherwise("reverse-dependency")
    none = F.array().cast("array<string>")
    out = out.select("id", "kind", "depth", F.coalesce("via", none).alias("via"), F.coalesce("edges", none).alias("edges"), reason.alias("reason"), test.alias("test_candidate"))
    return out.orderBy("depth", "id").limit(limit) if limit > 0 else out


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file) of two captures (file, mode, sha256) that differ in bytes or mode; a rename is a removal and an addition."""
    a, b = (x.select("file", F.struct("mode", "sha256").alias(n)) for x, n in ((before, "a"), (after, "b")))
    return a.join(b, "file", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("file")


def capture_hash(files: DataFrame) -> str:
    """Digest of a capture (file, mode, sha256), by sorted names."""
    import hashlib

    h = hashlib.sha256()
    for r in files.orderBy("file").toLocalIterator():
        h.update(f"{len(r.file.encode())}:{r.file}:{r.mode}:{r.sha256}\n".encode())
    return h.hexdigest()


def patch_impact(before: Graph, after: Graph, files_before: DataFrame, files_after: DataFrame, depth: int = 0, limit: int = 0) -> DataFrame:
    """Change candidates of both sides, kept apart by ``side``."""
    files = stage(changed_files(files_before, files_after), "changed")
    sides = [change_candidates(g, files, depth, limit).withColumn("side", F.lit(s)) for g, s in ((before, "before"), (after, "after"))]
    return sides[0].union(sides[1])
