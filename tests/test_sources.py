"""Documents, files and commands, there and back."""

import json

import pytest

from edgewise import graph as G
from edgewise.commands import Session, handle
from edgewise.operators.rules import Rules
from edgewise.sinks import export
from edgewise.sources import documents


def sample(spark):
    rows = [{"id": "p.a", "kind": "func", "exported": True, "position": ("/r/x.go", 3, 1)}, {"id": "p.b<", "kind": "func", "package": "p"}]
    return G.from_rows(spark, rows, [("p.a", "p.b<", "call")], tool="t", root="/r", roots=["p.a"], workspaceModules=[("m", "/r")])


def test_document_round_trip(spark, tmp_path):
    path = str(tmp_path / "g.json")
    export.save_document(sample(spark), path)
    text = open(path).read()
    assert "\\u003c" in text and json.loads(text)["edges"] == [{"from": "p.a", "to": "p.b<", "kind": "call"}]
    again = documents.load_document(spark, path)
    assert export.dumps(export.document(again)) == text and again.meta.roots == ["p.a"]
    raw = json.loads(text) | {"version": 99}
    open(path, "w").write(json.dumps(raw))
    with pytest.raises(ValueError):
        documents.load_document(spark, path)


def test_tables_round_trip(spark, tmp_path):
    export.save_tables(sample(spark), str(tmp_path / "v"), str(tmp_path / "e"))
    g = documents.load_tables(spark, str(tmp_path / "v"), str(tmp_path / "e"))
    assert g.vertices.count() == 2 and g.edges.first().src == "p.a"


def test_pictures_and_sarif(spark):
    g = sample(spark)
    assert export.mermaid(g) == 'graph LR\n  n0["p.a"]\n  n1["p.b<"]\n  n0 -->|call| n1\n'
    assert '"p.a" -> "p.b<" [label="call"];' in export.dot(g)
    out = export.sarif([{"rule": "r", "level": "error", "message": "m", "file": "/r/a b:c.go", "line": 2}], "t", "1", ["r"], "/r")
    assert out["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a%20b%3Ac.go"
    assert export.escape_text(" ::x\x07##[g\x85") == " \\x3a:x\\x07\\x23#[g\\u0085"


def test_rules_and_baselines(tmp_path):
    (tmp_path / "rules.yaml").write_text("components:\n  a: [a/**]\ndeny:\n  a: [{to: a, reason: no}]\n")
    r = documents.load_rules(documents.find_rules(str(tmp_path)))
    assert isinstance(r, Rules) and r.components == {"a": ["a/**"]}
    (tmp_path / "rules.yml").write_text("unknown: 1\n")
    with pytest.raises(ValueError):
        documents.load_rules(documents.find_rules(str(tmp_path)))
    p = str(tmp_path / "b.json")
    export.save_baseline(p, "t", "dead-baseline", [{"id": "x"}])
    assert documents.load_baseline(p, "t", "dead-baseline") == [{"id": "x"}]
    with pytest.raises(ValueError):
        documents.load_baseline(p, "t", "cycles-baseline")


def test_roots():
    assert documents.read_roots('["a", "b", "a"]') == ["a", "b"]
    assert documents.read_roots('{"facts": [{"symbol": {"usr": "x"}}, {}]}') == ["x"]
    with pytest.raises(ValueError):
        documents.read_roots('["a\\u0007"]')


def test_harvest_tables(spark):
    f = spark.createDataFrame
    types = f([("T", "a"), ("T", "b"), ("U", "a")], "id string, method string")
    assert [tuple(r)[:2] for r in documents.implements(types, f([("I", "a"), ("I", "b")], "id string, method string")).collect()] == [("T", "I")]
    requires = f([("x.com/m", False), ("x.com/m/sub", True), ("y.com/n", True)], "module string, indirect boolean")
    imports = f([("x.com/m/sub/pkg", None)], "path string, module string")
    assert {r.module for r in documents.unused_requires(requires, imports).collect()} == {"x.com/m", "y.com/n"}
    files = f([("a.go", "p", "// Code generated by x. DO NOT EDIT.\n\npackage p\n"), ("b.go", "p", "package p\n// Code generated by x. DO NOT EDIT.\n")], "file string, package string, text string")
    assert {r.file: r.generated for r in documents.generated_files(files).collect()} == {"a.go": True, "b.go": False}


def test_commands(spark):
    s = Session(sample(spark))
    assert s.path("p.a", "p.b<")["found"] and s.summary()["vertices"] == 2 and s.dead()["findings"] == []
    assert s.reach(["p.a", "zz"])["missingRoots"] == ["zz"] and s.shared(["p.a"])["shared"] == ["p.a", "p.b<"]
    call = lambda **m: handle(s, json.dumps({"jsonrpc": "2.0", "id": 1, **m}))
    assert len(call(method="tools/list")["result"]["tools"]) == 12
    assert call(method="nope")["error"]["code"] == -32601 and handle(s, "{")["error"]["code"] == -32700
    assert call(method="tools/call", params={"name": "query", "arguments": {"id": "zz"}})["result"]["isError"]
    assert not call(method="tools/call", params={"name": "query", "arguments": {"id": "p.a"}})["result"]["isError"]


def test_snapshot_stream(spark, tmp_path):
    from pyspark.sql import types as T

    from edgewise.streaming.snapshots import diff_snapshots

    schema = T.StructType([*G.EDGE.fields, T.StructField("snapshot", T.LongType())])
    rows = [("a", "b", "call", None, False, 1), ("a", "c", "call", None, False, 2)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = diff_snapshots(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    got = {(r.src, r.dst, r.change, r.snapshot) for r in spark.read.parquet(str(tmp_path / "out/changes")).collect()}
    assert got == {("a", "b", "added", 1), ("a", "b", "removed", 2), ("a", "c", "added", 2)}


def test_a_snapshot_in_two_batches(spark, tmp_path):
    from pyspark.sql import types as T

    from edgewise.streaming.snapshots import diff_snapshots

    schema = T.StructType([*G.EDGE.fields, T.StructField("snapshot", T.LongType())])
    parts = [[("a", "b", "call", 1)], [("a", "b", "call", 2), ("a", "c", "call", 1)], [("a", "c", "call", 2), ("a", "d", "call", 2)]]
    source = str(tmp_path / "in")
    for rows in parts:
        spark.createDataFrame([(s, d, k, None, False, n) for s, d, k, n in rows], schema).coalesce(1).write.mode("append").parquet(source)
        q = diff_snapshots(spark.readStream.schema(schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "c"))
        q.processAllAvailable()
        q.stop()
    got = {(r.src, r.dst, r.change, r.snapshot) for r in spark.read.parquet(str(tmp_path / "out/changes")).collect()}
    assert got == {("a", "b", "added", 1), ("a", "c", "added", 1), ("a", "d", "added", 2)}


def test_commands_with_baselines_files_and_schemas(spark, tmp_path):
    import json

    from edgewise import commands

    rows = [{"id": i, "kind": "package", "name": i, "position": {"file": f"/r/{i}/x.go", "line": 1, "column": 0}} for i in ("m/a", "m/b", "m/c")]
    edges = [("m/a", "m/b", "import"), ("m/b", "m/a", "import"), ("m/c", "m/a", "import")]
    s = Session(G.from_rows(spark, rows, edges, module="m", level="package", root="/r"))
    rules_file, base = str(tmp_path / "rules.yml"), str(tmp_path / "base.json")
    (tmp_path / "rules.yml").write_text(json.dumps({"components": {"a": ["a"], "b": ["b"], "c": ["c"]}, "deps": {"a": ["b"]}}))
    first = s.rules(rules_file, save_baseline=base)
    assert len(first["violations"]) == 2 and s.rules(rules_file, baseline=base)["violations"] == []
    (tmp_path / "rules.yml").write_text(json.dumps({"components": {"a": ["a"], "b": ["b"], "c": ["c"]}, "deps": {"c": ["a"]}}))
    after = s.rules(rules_file, baseline=base)
    assert [(v["from"], v["to"]) for v in after["violations"]] == [("m/a", "m/b")] and after["stale"] == 1
    assert len(s.rules(rules_file, sarif=True)["runs"][0]["results"]) == 2
    cycles_base = str(tmp_path / "cycles.json")
    assert len(s.cycles("package", save_baseline=cycles_base)["cycles"]) == 1 and s.cycles("package", baseline=cycles_base)["cycles"] == []
    assert s.cycles("package", sarif=True)["runs"][0]["results"][0]["message"]["text"] == "m/a -> m/b"
    got = s.affected(["m/b/x.go", "none.go"])
    assert {r["id"] for r in got["impact"]} == {"m/a", "m/c"} and got["unmappedFiles"] == ["none.go"] and not got["outputLimited"]
    assert s.impact("m/b", max=1)["outputLimited"] and s.query("m/a", max=1)["truncated"] == ["dependedBy"]
    assert {r["id"] for r in s.change(["m/b/x.go"])["candidates"]} == {"m/a", "m/b", "m/c"}
    schemas = {t["name"]: t["inputSchema"] for t in commands.handle(s, '{"id": 1, "method": "tools/list"}')["result"]["tools"]}
    assert schemas["query"]["required"] == ["id"] and schemas["query"]["properties"]["depth"]["type"] == "integer" and not schemas["query"]["additionalProperties"]
    wrong = commands.handle(s, '{"id": 1, "method": "tools/call", "params": {"name": "query", "arguments": {"id": "m/a", "dept": 2}}}')
    assert wrong["result"]["isError"] and "dept" in wrong["result"]["content"][0]["text"]
