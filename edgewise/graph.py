"""The property graph: one versioned document as two DataFrames and a metadata record.

Vertices and edges keep their optional columns; absent and empty lists are the same
(null), absent booleans are false, an absent position column is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 2
LEVELS = ["module", "package", "type", "symbol"]
SYMBOL_KINDS = ["type", "func", "method", "field", "var", "const"]
VIEW = {
    "module": (["module"], ["import"]),
    "package": (["package"], ["import"]),
    "type": (["type"], ["embeds", "implements", "references"]),
    "symbol": (SYMBOL_KINDS, ["call", "implements", "embeds", "references"]),
}

POSITION = T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType())])
_strings = T.ArrayType(T.StringType())
VERTEX = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "kind", "name", "package")]
    + [T.StructField("position", POSITION)]
    + [T.StructField("exported", T.BooleanType()), T.StructField("external", T.BooleanType()), T.StructField("module", T.StringType())]
    + [T.StructField("generated", T.BooleanType()), T.StructField("interface", T.BooleanType())]
    + [T.StructField(n, _strings) for n in ("fields", "tagKeys", "methods", "typeSet")]
    + [T.StructField("value", T.StringType()), T.StructField("satisfies", _strings), T.StructField("receiver", T.StringType())]
)
EDGE = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("positions", T.ArrayType(POSITION)), T.StructField("candidate", T.BooleanType())])


@dataclass
class Meta:
    """The document's own record; markers say which facts it carries at all."""

    version: int = VERSION
    tool: str = ""
    level: str = "symbol"
    root: str = ""
    module: str = ""
    moduleDir: str = ""
    workspaceModules: list = field(default_factory=list)
    roots: list = field(default_factory=list)
    limitations: list = field(default_factory=list)
    anonymousDispatch: bool = False
    interfaceMethodSets: bool = False
    interfaceTypeSets: bool = False
    initializerRoots: bool = False
    dispatchEvidence: bool = False
    moduleLocalDispatch: bool = False


@dataclass
class Graph:
    vertices: DataFrame
    edges: DataFrame
    meta: Meta = field(default_factory=Meta)

    @property
    def spark(self):
        return self.vertices.sparkSession

    def with_(self, **changes) -> Graph:
        return replace(self, **changes)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """All columns of ``schema``: missing ones as null, booleans false, empty lists null, columns 0."""
    out = []
    for f in schema:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.BooleanType):
            c = F.coalesce(c, F.lit(False))
        elif f.name == "positions":
            c = F.transform(c, _column)
            c = F.when(F.size(c) > 0, c)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.when(F.size(c) > 0, c)
        elif f.name == "position":
            c = F.when(c.isNotNull(), _column(c))
        out.append(c.alias(f.name))
    return df.select(*out)


def _column(p: Column) -> Column:
    return F.struct(p["file"].alias("file"), p["line"].alias("line"), F.coalesce(p["column"], F.lit(0)).alias("column"))


def graph(vertices: DataFrame, edges: DataFrame, meta: Meta | None = None) -> Graph:
    return Graph(conform(vertices, VERTEX), conform(edges, EDGE), meta or Meta())


def from_rows(spark, vertices: list[dict], edges: list[tuple], **meta) -> Graph:
    """A small graph from Python values; edges are (src, dst, kind[, candidate])."""
    v = spark.createDataFrame([tuple(x.get(f.name) for f in VERTEX) for x in vertices], VERTEX)
    e = spark.createDataFrame([(x[0], x[1], x[2], None, bool(x[3]) if len(x) > 3 else False) for x in edges], EDGE)
    return graph(v, e, Meta(**meta))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row a (src, dst, kind): positions joined, sorted and distinct; a candidate only if all are."""
    positions = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("positions", F.array().cast(T.ArrayType(POSITION)))))))
    out = edges.groupBy("src", "dst", "kind").agg(positions.alias("positions"), F.bool_and("candidate").alias("candidate"))
    return out.withColumn("positions", F.when(F.size("positions") > 0, F.col("positions")))


def normalize(g: Graph) -> Graph:
    """Merged relations and sorted metadata; row order is a matter of the sinks."""
    meta = replace(g.meta, roots=sorted(g.meta.roots), limitations=sorted(g.meta.limitations), workspaceModules=sorted(g.meta.workspaceModules))
    return g.with_(edges=merge_edges(g.edges), meta=meta)


def view(g: Graph, level: str) -> Graph:
    """Vertices and edges of a level; both ends of an edge must stay."""
    if level not in VIEW:
        raise ValueError(f"unknown level: {level}")
    kinds, edge_kinds = VIEW[level]
    vertices = g.vertices.where(F.col("kind").isin(kinds))
    ids = vertices.select("id").distinct()
    edges = g.edges.where(F.col("kind").isin(edge_kinds))
    edges = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return normalize(g.with_(vertices=vertices, edges=edges.select(*EDGE.names)))


def require_level(g: Graph, level: str) -> None:
    """Raise unless the document is at least as fine as ``level``; module views come from module documents."""
    have = g.meta.level
    if have not in LEVELS or level not in LEVELS:
        raise ValueError(f"unknown level: {have if have not in LEVELS else level}")
    if (level == "module") != (have == "module") or LEVELS.index(have) < LEVELS.index(level):
        raise ValueError(f"document level {have} does not hold the {level} level")


def symbols(g: Graph) -> DataFrame:
    return g.vertices.where(F.col("kind").isin(SYMBOL_KINDS))


def live_roots(g: Graph) -> DataFrame:
    """(id) of the recorded roots that are vertices."""
    roots = g.spark.createDataFrame([(r,) for r in g.meta.roots], "id string")
    return roots.join(g.vertices.select("id").distinct(), "id", "left_semi")


def dependencies(g: Graph) -> DataFrame:
    """All edges but ownership."""
    return g.edges.where("kind <> 'contains'")


def neighbors(g: Graph) -> DataFrame:
    """Distinct dependency pairs (src, dst) with sorted kinds."""
    return dependencies(g).groupBy("src", "dst").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def edge_kinds(g: Graph, src: str, dst: str) -> DataFrame:
    """Kinds of all edges of one pair, repeats kept."""
    return g.edges.where((F.col("src") == src) & (F.col("dst") == dst)).select("kind")


def vertex(g: Graph, id: str) -> DataFrame:
    return g.vertices.where(F.col("id") == id).limit(1)


def summary(g: Graph) -> dict:
    return {"vertices": g.vertices.count(), "edges": g.edges.count(), **g.meta.__dict__}
