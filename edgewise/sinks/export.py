"""Writers: JSON documents and reports, Mermaid, DOT, SARIF, escaped text, atomic files."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.graph import Graph, normalize

#: Characters that JSON for web pages spells as escapes.
_WEB = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029"}


def dumps(value) -> str:
    text = json.dumps(value, indent=2, ensure_ascii=False)
    return re.sub("[<>&  ]", lambda m: _WEB[m[0]], text) + "\n"


def _thin(row: dict) -> dict:
    """A row without empty optional values."""
    return {k: _thin(v) if isinstance(v, dict) else [_thin(x) if isinstance(x, dict) else x for x in v] if isinstance(v, list) else v for k, v in row.items() if v not in (None, False, [], "", 0) or k in ("id", "kind", "from", "to", "line")}


def document(g: Graph) -> dict:
    """The document as one JSON value, sorted; for graphs of a size that a JSON file is meant for."""
    g = normalize(g)
    head = _thin({**g.meta.__dict__, "workspaceModules": [{"path": p, "dir": d} for p, d in g.meta.workspaceModules]})
    vertices = [_thin(r.asDict(True)) for r in g.vertices.orderBy("id").toLocalIterator()]
    edges = [_thin(r.asDict(True)) for r in g.edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", "positions", "candidate").orderBy("from", "to", "kind").toLocalIterator()]
    return {**head, "vertices": vertices, "edges": edges}


def save_document(g: Graph, path: str) -> None:
    write_atomic(path, dumps(document(g)))


def save_tables(g: Graph, vertices: str, edges: str) -> None:
    """Two Parquet tables, written by the executors."""
    normalized = normalize(g)
    normalized.vertices.write.parquet(vertices)
    normalized.edges.write.parquet(edges)


def report(df: DataFrame, name: str, **fields) -> dict:
    """A report of rows under ``name``; absent lists are empty lists."""
    rows = [{k: ([] if v is None and dict(df.dtypes)[k].startswith("array") else v) for k, v in r.asDict(True).items()} for r in df.toLocalIterator()]
    return {**fields, name: rows}


def graph_revision(g: Graph) -> str:
    return hashlib.sha256(dumps(document(g)).encode()).hexdigest()


def _numbered(g: Graph):
    ids = [r.id for r in g.vertices.select("id").distinct().orderBy("id").toLocalIterator()]
    edges = g.edges.where("kind <> 'contains'").select("src", "dst", "kind").distinct().orderBy("src", "dst", "kind").toLocalIterator()
    return ids, edges


def mermaid(g: Graph) -> str:
    ids, edges = _numbered(g)
    at = {x: f"n{k}" for k, x in enumerate(ids)}
    lines = ["graph LR", *(f'  {at[x]}["{x.replace(chr(34), "#quot;")}"]' for x in ids)]
    lines += [f"  {at[e.src]} -->|{e.kind}| {at[e.dst]}" for e in edges if e.src in at and e.dst in at]
    return "\n".join(lines) + "\n"


def dot(g: Graph) -> str:
    ids, edges = _numbered(g)
    q = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return "\n".join(["digraph {", *(f"  {q(x)};" for x in ids), *(f"  {q(e.src)} -> {q(e.dst)} [label={q(e.kind)}];" for e in edges), "}"]) + "\n"


def escape_text(s: str) -> str:
    """Control characters and command marks of build logs made visible."""
    s = re.sub("[\x00-\x1f\x7f]", lambda m: f"\\x{ord(m[0]):02x}", s)
    s = re.sub("[\x80-\x9f  ]", lambda m: f"\\u{ord(m[0]):04x}", s)
    s = re.sub(r"^(\s*)::", r"\1\\x3a:", s)
    return s.replace("##[", "\\x23#[")


SARIF_RULES = ["layer-deny", "layer-signature", "layer-allow", "layer-visibleTo", "layer-fileScope", "layer-forbidden", "layer-independence"]


def sarif_uri(path: str) -> str:
    return quote(path, safe="/-._~!$&'()*+,;=@")


def sarif(results: list[dict], tool: str, version: str, rules: list[str], root: str = "") -> dict:
    """SARIF 2.1.0 of results {rule, level, message, file, line, column}; a file outside the root is named in the text."""
    out = []
    for r in results:
        item = {"ruleId": r["rule"], "level": r["level"], "message": {"text": r["message"]}}
        file = r.get("file")
        if file:
            rel = file[len(root) + 1 :] if root and file.startswith(root + "/") else file
            if rel.startswith(("/", "..")):
                item["message"]["text"] += f" (at {file})"
            else:
                region = {"startLine": r.get("line") or 1, **({"startColumn": r["column"]} if r.get("column") else {})}
                item["locations"] = [{"physicalLocation": {"artifactLocation": {"uri": sarif_uri(rel), "uriBaseId": "%SRCROOT%"}, "region": region}}]
        out.append(item)
    driver = {"name": tool, "version": version, "rules": [{"id": r} for r in rules]}
    return {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": out}]}


def violations_sarif(violations: DataFrame, tool: str, version: str, root: str = "") -> dict:
    rows = [
        {"rule": f"layer-{v.rule}", "level": "error", "message": f"{v['from'] or v.fromComponent or v.toComponent} -> {v['to']}: {v.rule} {v.reason}".strip(), "file": v.position and v.position.file, "line": v.position and v.position.line, "column": v.position and v.position.column}
        for v in violations.toLocalIterator()
    ]
    return sarif(rows, tool, version, SARIF_RULES, root)


def findings_sarif(findings: DataFrame, tool: str, version: str, root: str = "") -> dict:
    rows = [{"rule": "unreachable", "level": "warning", "message": f"{v.id}: {v.reason}", "file": v.position and v.position.file, "line": v.position and v.position.line, "column": v.position and v.position.column} for v in findings.orderBy("id").toLocalIterator()]
    return sarif(rows, tool, version, ["unreachable"], root)


def cycles_sarif(members: DataFrame, tool: str, version: str) -> dict:
    rows = members.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("ids")).orderBy("component").toLocalIterator()
    return sarif([{"rule": "cycle", "level": "error", "message": " -> ".join(r.ids)} for r in rows], tool, version, ["cycle"])


def write_atomic(path: str, text: str) -> None:
    """The whole file or none: a temporary file of mode 0600 beside it, then a rename."""
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def save_baseline(path: str, tool: str, kind: str, entries: list) -> None:
    name = {"violations-baseline": "violations", "cycles-baseline": "cycles", "dead-baseline": "findings"}[kind]
    write_atomic(path, dumps({"tool": tool, "kind": kind, "version": 1, name: entries}))
