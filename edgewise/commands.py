"""The command surface: one function a command, and a line protocol over a loaded graph.

Exit codes: 0, 1 for findings under ``--strict``, 2 for errors, 64 for usage of traversals.
"""

from __future__ import annotations

import argparse
import inspect
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from edgewise import graph as G
from edgewise.functions import routes as router
from edgewise.functions import sqlrel, wrappers
from edgewise.functions.ids import canonical_id, portable_position, utf16_key
from edgewise.operators import cycles, diff, queries, rules, traversal
from edgewise.operators.reach import reachable
from edgewise.session import stage
from edgewise.sinks import export
from edgewise.sources import documents, harvest

TOOL, VERSION = "edgewise", "0.1.0"


def rows(df) -> list[dict]:
    return [r.asDict(True) for r in df.toLocalIterator()]


class Session:
    """Commands over one document, whose normalised tables are read once."""

    def __init__(self, g: G.Graph):
        g = G.normalize(g)
        self.g = g.with_(vertices=stage(g.vertices, "vertices"), edges=stage(g.edges, "edges"))

    def _against(self, df, key, kind, baseline=None, save_baseline=None):
        """Rows of ``df`` that a baseline file does not have, and how many of its entries are stale. ``key``: of a
        row, by which the baseline matches; ``save_baseline``: where all rows go as a new baseline."""
        ordered = F.to_json(F.struct(*df.columns))
        keyed = stage(df.distinct().withColumns({"key": key, "ord": ordered}), "keyed")
        if save_baseline:
            out = keyed.orderBy("ord").drop("key", "ord")
            if "position" in out.columns:
                out = out.withColumn("position", portable_position(F.col("position"), self.g.meta.moduleDir or self.g.meta.root))
            export.save_baseline(save_baseline, TOOL, kind, rows(out))
        if not baseline:
            return keyed.drop("key", "ord"), 0
        known = [tuple(x.get(c) for c in df.columns) for x in documents.load_baseline(baseline, TOOL, kind)]
        base = self.g.spark.createDataFrame(known, df.schema).withColumns({"key": key, "ord": ordered})
        states = stage(diff.split_baseline(keyed.select("key", "ord"), base.select("key", "ord")), "states")
        fresh = keyed.join(states.where("state = 'fresh'").select("key", "ord").distinct(), ["key", "ord"], "left_semi")
        return fresh.drop("key", "ord"), states.where("state = 'stale'").count()

    def graph(self, level=""):
        return export.document(G.view(self.g, level) if level else self.g)

    def summary(self):
        return G.summary(self.g)

    def cycles(self, level="symbol", baseline=None, save_baseline=None, sarif=False):
        G.require_level(self.g, level)
        v = G.view(self.g, level)
        found = stage(cycles.cycles(v), "cycles")
        members = found.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members"))
        key = F.array_join(F.array_sort(F.transform("members", canonical_id)), "\0")
        members, stale = self._against(members, key, "cycles-baseline", baseline, save_baseline)
        if sarif:
            return export.cycles_sarif(members.select("component", F.explode("members").alias("id")), TOOL, VERSION)
        evidence = cycles.evidence(v, found.join(members, "component", "left_semi"))
        return {"cycles": rows(members.orderBy("component")), "evidence": rows(evidence.drop("position").orderBy("src", "dst", "kind")), "stale": stale}

    def dead(self, public=False, roots=(), rta=None, baseline=None, save_baseline=None, sarif=False):
        start, unknown = queries.retention_roots(self.g, public, list(roots))
        reach = stage(reachable(queries.reach_pairs(self.g), start), "reach")
        out = queries.dead(self.g, reach) if rta is None else queries.dead_rta(self.g, reach, self._table(rta).select("id"))
        out, stale = self._against(out, diff.finding_key(), "dead-baseline", baseline, save_baseline)
        if sarif:
            return export.findings_sarif(out, TOOL, VERSION, self.g.meta.root)
        return {"roots": [r.id for r in start.orderBy("id").collect()], "unknownRoots": unknown, "findings": rows(out.orderBy("id")), "stale": stale}

    def explain(self, id, public=False, roots=()):
        start, _ = queries.retention_roots(self.g, public, list(roots))
        return {"path": [r.id for r in queries.explain(self.g, id, start).collect()]}

    def rules(self, rules_file, baseline=None, save_baseline=None, sarif=False):
        r = documents.load_rules(rules_file)
        m = rules.mapping(self.g, r)
        found, stale = self._against(rules.check(self.g, r), diff.violation_key(), "violations-baseline", baseline, save_baseline)
        if sarif:
            return export.violations_sarif(rules.ordered(found), TOOL, VERSION, self.g.meta.root)
        return {
            "violations": rows(rules.ordered(found)), "stale": stale,
            "unmapped": [x.id for x in m.where("component is null and not is_external").orderBy("id").collect()],
            "unmappedExternal": [x.id for x in m.where("component is null and is_external").orderBy("id").collect()],
            "unmatchedComponents": rules.unmatched_components(self.g, r),
        }

    def query(self, id, depth=1, max=0):
        """Both directions; one that was cut to ``max`` is named in ``truncated``."""
        found = stage(queries.query(self.g, id, depth, max + 1 if max else 0), "query")
        counts = {r.direction: r["count"] for r in found.groupBy("direction").count().collect()}
        kept = queries.query(self.g, id, depth, max) if max else found
        return {"neighbors": rows(kept.orderBy("direction", "id")), "truncated": sorted(d for d, n in counts.items() if max and n > max)}

    def _impact(self, ids, depth, max):
        found = stage(queries.impact(self.g, ids, depth, max + 1 if max else 0), "impact")
        limited = bool(max) and found.count() > max
        kept = queries.impact(self.g, ids, depth, max) if limited else found
        return {"impact": rows(kept.orderBy("depth", "id")), "depthLimited": queries.depth_limited(self.g, ids, depth), "outputLimited": limited}

    def impact(self, id, depth=0, max=0):
        return self._impact([id] if isinstance(id, str) else list(id), depth, max)

    def _files(self, files):
        return self.g.spark.createDataFrame([(x,) for x in files], "file string")

    def affected(self, files, roots=(), depth=0, max=0):
        """Impact of the vertices that ``files`` declare, and of ``roots``."""
        picked, unmapped = queries.vertices_of_files(self.g, self._files(files))
        ids = sorted({r.id for r in picked.collect()} | set(roots))
        none = {"impact": [], "depthLimited": False, "outputLimited": False}
        return {**(self._impact(ids, depth, max) if ids else none), "unmappedFiles": [r.file for r in unmapped.orderBy("file").collect()]}

    def change(self, files, depth=0, max=0):
        """What a change of ``files`` may touch."""
        return {"candidates": rows(queries.change_candidates(self.g, self._files(files), depth, max).orderBy("depth", "id"))}

    def path(self, src, dst):
        steps = rows(queries.path(self.g, src, dst).orderBy("step"))
        return {"found": bool(steps), "path": steps}

    def shared(self, ids):
        found = stage(queries.shared(self.g, list(ids)), "shared")
        common = [r.id for r in found.where(F.col("n") == len(ids)).orderBy("id").collect()]
        only = {x: [r.id for r in found.where(F.array_contains("roots", k) & (F.col("n") < len(ids))).orderBy("id").collect()] for k, x in enumerate(ids)}
        return {"shared": common, "only": only}

    def diff(self, other):
        old, new = self.g, documents.load_document(self.g.spark, other)
        v = diff.vertex_diff(old, new).orderBy("id")
        e = diff.edge_diff(old, new).orderBy("src", "dst", "kind")
        return {
            "addedVertices": [r.id for r in v.where("change = 'added'").collect()], "removedVertices": [r.id for r in v.where("change = 'removed'").collect()],
            "edges": rows(e), "changedVertices": rows(diff.attribute_changes(old, new)), "fieldChanges": rows(diff.field_changes(old, new)),
            "signatureChanges": rows(diff.signature_diff(old, new)), "breaking": [r.message for r in diff.breaking(old, new).orderBy("phase", "key", "seq", "message").collect()],
            "notes": diff.notes(old, new),
        }

    def metrics(self, rules_file=None):
        r = documents.load_rules(rules_file) if rules_file else None
        return {"components": rows(rules.metrics(self.g, r).orderBy("name")), "orphans": [x.id for x in rules.orphans(self.g).orderBy("id").collect()]}

    def mapping(self, rules_file):
        m = rules.mapping(self.g, documents.load_rules(rules_file))
        return rows(m.where("component is not null").groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("packages")).orderBy("component"))

    def init(self):
        return rules.scaffold(self.g).__dict__

    def reach(self, roots, dependents=False, depth=traversal.MAX_DEPTH, max=traversal.MAX_REACHED, members=False, project=""):
        have = {r.id for r in self.g.vertices.where(F.col("id").isin(list(roots))).select("id").collect()}
        missing = [r for r in roots if r not in have]
        out, reasons = traversal.traverse(self.g, list(roots), dependents, depth, max, members)
        symbols = harvest.symbols_of(self.g, out.select("id"), project or self.g.meta.root).drop("id").orderBy(utf16_key(F.col("usr")))
        reached = rows(out.orderBy("depth", utf16_key(F.col("id"))))
        return {"graphRevision": export.graph_revision(self.g), "reached": reached, "symbols": rows(symbols), "truncation": reasons, "missingRoots": missing}

    # Commands over fact tables take the paths of Parquet tables.

    def _table(self, path):
        return self.g.spark.read.parquet(path)

    def unused_deps(self, requires, imports):
        return {"unused": rows(documents.unused_requires(self._table(requires), self._table(imports)).orderBy("module"))}

    def schema(self, texts, column="text"):
        found = sqlrel.relation_facts(self._table(texts), column)
        return {"facts": rows(found.orderBy(*(c for c in ("path", "line", "column", column) if c in found.columns)))}

    def routes(self, registrations, routers, parents, slash_middleware=()):
        got = router.route_facts(self._table(registrations), self._table(routers), self._table(parents), self.g.vertices, tuple(slash_middleware))
        limits, scopes = router.limitations(got.gaps)
        return {"facts": rows(router.ordered_routes(got.facts)), "limitations": limits, "limitationScopes": scopes}

    def bridges(self, calls, wrappers_file, declared, direct=None):
        """Client calls: those of declared wrappers, and ``direct`` ones in the columns of ``client_facts``.
        ``declared``: owner, name and vertex id of the declarations that were read."""
        mine = wrappers.load_wrappers(documents.read_text(wrappers_file, wrappers.MAX_BYTES))
        made = stage(wrappers.wrapper_calls(self._table(calls), mine), "wrapper-calls")
        known = self._table(declared)
        no, yes = F.lit(False), F.lit(True)
        every = made.where("bound").withColumns({"unresolved": no, "parameter": no, "from_wrapper": yes})
        if direct:
            every = every.unionByName(self._table(direct), allowMissingColumns=True)
        bodies = known.join(self.g.spark.createDataFrame([(w["owner"], w["name"]) for w in mine], "owner string, name string"), ["owner", "name"])
        facts, counts = wrappers.client_facts(every, bodies.select(F.col("id").alias("owner")), self.g.vertices)
        return {"facts": rows(wrappers.ordered_calls(facts)), "counts": rows(counts)[0], "wrappers": rows(wrappers.wrapper_gaps(made, mine, known).orderBy("wrapper"))}

    def mermaid(self, level=""):
        return export.mermaid(G.view(self.g, level) if level else self.g)

    def dot(self, level=""):
        return export.dot(G.view(self.g, level) if level else self.g)


TOOLS = ["summary", "query", "impact", "affected", "change", "path", "shared", "cycles", "dead", "rules", "metrics", "mapping"]
COMMANDS = [*TOOLS, "graph", "explain", "diff", "init", "reach", "mermaid", "dot", "unused-deps", "schema", "routes", "bridges"]


def tool(name: str) -> dict:
    """Name, description and input schema of a tool, from its function's signature."""
    f = getattr(Session, name)
    kinds = {bool: "boolean", int: "integer", str: "string", tuple: "array"}
    listed = {"ids", "files"}
    fields = [p for p in inspect.signature(f).parameters.values() if p.name != "self"]
    needed = [p.name for p in fields if p.default is p.empty]
    properties = {p.name: {"type": "array" if p.name in listed else "string" if p.default in (p.empty, None) else kinds[type(p.default)]} for p in fields}
    schema = {"type": "object", "properties": properties, "required": needed, "additionalProperties": False}
    return {"name": name, "description": inspect.getdoc(f) or f"The {name} of the graph.", "inputSchema": schema}


def handle(session: Session, message: str) -> dict | None:
    """Answer one JSON-RPC line; a failing tool is content, not a protocol error."""
    try:
        m = json.loads(message)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
    if "id" not in m:
        return None
    say = lambda result: {"jsonrpc": "2.0", "id": m["id"], "result": result}
    no = lambda code, text: {"jsonrpc": "2.0", "id": m["id"], "error": {"code": code, "message": text}}
    method, params = m.get("method"), m.get("params") or {}
    if method == "initialize":
        return say({"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": TOOL, "version": VERSION}})
    if method == "ping":
        return say({})
    if method == "tools/list":
        return say({"tools": [tool(t) for t in TOOLS]})
    if method != "tools/call":
        return no(-32601, f"no such method: {method}")
    if params.get("name") not in TOOLS:
        return no(-32602, f"no such tool: {params.get('name')}")
    try:
        text, failed = export.dumps(getattr(session, params["name"])(**(params.get("arguments") or {}))), False
    except Exception as e:  # the tool's failure goes to the caller
        text, failed = str(e), True
    return say({"content": [{"type": "text", "text": text}], "isError": failed})


def serve(session: Session, lines=sys.stdin, out=sys.stdout) -> None:
    for line in lines:
        if line.strip() and (answer := handle(session, line)) is not None:
            print(json.dumps(answer), file=out, flush=True)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog=TOOL)
    p.add_argument("command", choices=[*COMMANDS, "mcp", "version"])
    p.add_argument("--graph", help="a JSON graph document")
    p.add_argument("--arguments", default="{}", help="the command's arguments as JSON")
    p.add_argument("--strict", action="store_true")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if a.command == "version":
        print(TOOL, VERSION)
        return 0
    try:
        arguments = json.loads(a.arguments)
        spark = SparkSession.builder.getOrCreate()
        session = Session(documents.load_document(spark, a.graph))
        if a.command == "mcp":
            serve(session)
            return 0
        result = getattr(session, a.command.replace("-", "_"))(**arguments)
    except Exception as e:
        print(f"{TOOL}: {export.escape_text(str(e))}", file=sys.stderr)
        return 2
    sys.stdout.write(result if isinstance(result, str) else export.dumps(result))
    if a.command == "reach" and result["missingRoots"]:
        return 64
    found = result.get("violations") or result.get("cycles") or result.get("findings") if isinstance(result, dict) else None
    return 1 if a.strict and found else 0


if __name__ == "__main__":
    sys.exit(main())
