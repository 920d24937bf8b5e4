"""Readers: graph documents, rules files, baselines, root lists, captures, call graphs."""

from __future__ import annotations

import json
import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgewise.graph import EDGE, VERSION, VERTEX, Graph, Meta, graph
from edgewise.operators.rules import Rules, validate

_EDGE_JSON = T.StructType([T.StructField({"src": "from", "dst": "to"}.get(f.name, f.name), f.dataType) for f in EDGE])
_WORKSPACE = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("dir", T.StringType())]))
_FLAGS = ["anonymousDispatch", "interfaceMethodSets", "interfaceTypeSets", "initializerRoots", "dispatchEvidence", "moduleLocalDispatch"]
DOCUMENT = T.StructType(
    [T.StructField("version", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("tool", "level", "root", "module", "moduleDir")]
    + [T.StructField("workspaceModules", _WORKSPACE), T.StructField("roots", T.ArrayType(T.StringType())), T.StructField("limitations", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.BooleanType()) for n in _FLAGS]
    + [T.StructField("vertices", T.ArrayType(VERTEX)), T.StructField("edges", T.ArrayType(_EDGE_JSON))]
)
MAX_RULES_BYTES = 16 << 20


def load_document(spark: SparkSession, path: str) -> Graph:
    """A JSON graph document; a newer version is refused, absent fields take their defaults."""
    doc = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    head = doc.drop("vertices", "edges").first()
    if head is None:
        raise ValueError(f"no document in {path}")
    if (head.version or 0) > VERSION:
        raise ValueError(f"document version {head.version} is newer than {VERSION}")
    values = {k: v for k, v in head.asDict(True).items() if v is not None}
    values["workspaceModules"] = [(m["path"], m["dir"]) for m in values.get("workspaceModules", [])]
    vertices = doc.select(F.inline("vertices"))
    edges = doc.select(F.inline("edges")).withColumnRenamed("from", "src").withColumnRenamed("to", "dst")
    return graph(vertices, edges, Meta(**values))


def load_tables(spark: SparkSession, vertices: str, edges: str, meta: Meta | None = None) -> Graph:
    """A graph kept as two Parquet tables: the form for documents too large for one JSON value."""
    return graph(spark.read.parquet(vertices), spark.read.parquet(edges), meta)


def read_text(path: str, most: int) -> str:
    """A regular file of at most ``most`` bytes."""
    s = os.stat(path)
    if not stat.S_ISREG(s.st_mode):
        raise ValueError(f"no regular file: {path}")
    if s.st_size > most:
        raise ValueError(f"larger than {most} bytes: {path}")
    with open(path, encoding="utf-8") as f:
        return f.read()


def find_rules(folder: str) -> str | None:
    """The rules file of a folder: .yml before .yaml."""
    for name in ("rules.yml", "rules.yaml"):
        if os.path.exists(p := os.path.join(folder, name)):
            return p
    return None


def load_rules(path: str) -> Rules:
    """A YAML (or JSON) rules file, checked."""
    text = read_text(path, MAX_RULES_BYTES)
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        raw = json.loads(text)
    raw = {k: v for k, v in (raw or {}).items() if v is not None}
    unknown = sorted(set(raw) - set(Rules.__dataclass_fields__))
    if unknown:
        raise ValueError(f"unknown sections: {unknown}")
    return validate(Rules(**raw))


def load_baseline(path: str, tool: str, kind: str) -> list:
    """Entries of a baseline file of one tool and kind."""
    raw = json.loads(read_text(path, MAX_RULES_BYTES))
    if raw.get("tool") != tool or raw.get("kind") != kind or raw.get("version") != 1:
        raise ValueError(f"no {kind} of {tool}, version 1: {path}")
    return raw.get({"violations-baseline": "violations", "cycles-baseline": "cycles", "dead-baseline": "findings"}[kind], [])


def read_roots(text: str) -> list[str]:
    """Roots of a JSON list or of a fact document's symbols, once each in their order."""
    raw = json.loads(text)
    if isinstance(raw, dict):
        raw = [f.get("symbol", {}).get("usr") for f in raw.get("facts", [])]
    out = list(dict.fromkeys(x for x in raw if x))
    for x in out:
        if not isinstance(x, str) or any(ord(c) < 0x20 or 0x7F <= ord(c) <= 0x9F for c in x):
            raise ValueError(f"no root: {x!r}")
    return out


def call_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of an ingested call graph table."""
    t = spark.read.parquet(path)
    return t.select(F.col(t.columns[0]).alias("src"), F.col(t.columns[1]).alias("dst")).distinct()


def package_graph(packages: DataFrame, imports: DataFrame, exclude: list[str] = (), meta: Meta | None = None) -> Graph:
    """A package document from package rows (id, name, module, external) and import rows (src, dst, position).

    Excluded packages and imports with a missing end go; how many go is a limitation.
    """
    from edgewise.functions.ids import excluded, module_relative

    meta = meta or Meta()
    kept = packages.where(~excluded(list(exclude), module_relative(F.col("id"), F.lit(meta.module))))
    ids = kept.select("id").distinct()
    inside = imports.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    full = inside.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    lost = inside.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("dst").distinct().count()
    limits = [*meta.limitations, *([f"{lost} imported packages are not in the document"] if lost else [])]
    vertices = kept.withColumn("kind", F.lit("package"))
    edges = full.groupBy("src", "dst").agg(F.collect_list("position").alias("positions")).withColumn("kind", F.lit("import"))
    return graph(vertices, edges, Meta(**{**meta.__dict__, "level": "package", "limitations": limits}))


def module_graph(packages: DataFrame, imports: DataFrame, meta: Meta | None = None) -> Graph:
    """Modules and their distinct imports across modules, without positions."""
    of = packages.select("id", "module").distinct()
    pairs = imports.join(of.select(F.col("id").alias("src"), F.col("module").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("module").alias("b")), "dst")
    pairs = pairs.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("import").alias("kind")).distinct()
    vertices = of.where("module <> ''").select(F.col("module").alias("id"), F.lit("module").alias("kind"), F.col("module").alias("name")).distinct()
    return graph(vertices, pairs, Meta(**{**(meta or Meta()).__dict__, "level": "module"}))


def implements(types: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(src, dst, kind): types whose methods (id, method) hold all of an interface's (id, method).

    Relational division: a join on the method and a count, no pair of type and interface without a method in common.
    """
    size = interfaces.groupBy("id").agg(F.count_distinct("method").alias("n")).select(F.col("id").alias("dst"), "n")
    hits = types.select(F.col("id").alias("src"), "method").distinct().join(interfaces.select(F.col("id").alias("dst"), "method").distinct(), "method")
    return hits.groupBy("src", "dst").agg(F.count("*").alias("k")).join(size, "dst").where("k = n and src <> dst").select("src", "dst", F.lit("implements").alias("kind"))


def dispatch(calls: DataFrame, implementations: DataFrame) -> DataFrame:
    """Candidate calls from interface calls (src, dst) to the methods (dst, impl) that may answer."""
    return calls.join(implementations, "dst").select("src", F.col("impl").alias("dst"), F.lit("call").alias("kind"), F.lit(True).alias("candidate")).distinct()


GENERATED = r"(?m)^// Code generated .* DO NOT EDIT\.$"


def generated_files(files: DataFrame) -> DataFrame:
    """(file, package, generated): a mark on a line before the package clause."""
    head = F.regexp_extract("text", r"(?s)\A(.*?)(?:^|\n)package\s", 1)
    return files.select("file", "package", head.rlike(GENERATED).alias("generated"))


def mark_generated(g: Graph, files: DataFrame) -> Graph:
    """Vertices of generated files; a package only if all its files are."""
    f = generated_files(files)
    by_file = f.select("file", F.col("generated").alias("_g")).distinct()
    by_package = f.groupBy(F.col("package").alias("id")).agg(F.bool_and("generated").alias("_p"))
    v = g.vertices.join(by_file, F.col("position.file") == by_file.file, "left").drop(by_file.file).join(by_package, "id", "left")
    mark = F.when(F.col("kind") == "package", F.coalesce("_p", F.lit(False))).otherwise(F.coalesce("_g", "generated"))
    return g.with_(vertices=v.withColumn("generated", mark).select(*VERTEX.names))


def unused_requires(requires: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, indirect) of requires (module, indirect) that no import (path, module or null) uses.

    An import without a module belongs to the longest required prefix of its path.
    """
    direct = imports.where("module is not null").select("module")
    parts = imports.where("module is null").select("path", F.split("path", "/").alias("s"))
    above = parts.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda n: F.array_join(F.slice("s", F.lit(1), n), "/"))).alias("module"))
    owner = above.join(requires.select("module"), "module").groupBy("path").agg(F.max_by("module", F.length("module")).alias("module")).select("module")
    return requires.join(direct.union(owner).distinct(), "module", "left_anti")


def test_only_imports(production: DataFrame, tests: DataFrame) -> DataFrame:
    """(package) that only tests import."""
    return tests.select("package").distinct().join(production.select("package"), "package", "left_anti")


def prune_hidden(methods: DataFrame) -> DataFrame:
    """Methods (…, satisfies array<struct<name, hidden>>) with hidden names dropped, unless nothing else is left."""
    seen = F.filter("satisfies", lambda x: ~x["hidden"])
    kept = F.when(F.size(seen) > 0, seen).otherwise(F.col("satisfies"))
    return methods.withColumn("satisfies", F.transform(kept, lambda x: x["name"]))
