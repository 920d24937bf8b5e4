"""Prefix chains, declared routes, scopes, wrappers and client facts from small fact tables."""

import json

import pytest
from pyspark.sql import functions as F

from edgewise.functions import routes, wrappers

ROUTERS = "router string, derived boolean, slash string"
PARENTS = "child string, at int, parent string, kind string, prefix string, dynamic boolean"
REGS = "id long, router string, framework string, pattern string, methods array<string>, mount boolean, handler string, anonymous boolean, path string, line int, column int"


def _vertices(spark, *ids):
    return spark.createDataFrame([(i, "func") for i in ids], "id string, kind string")


def _routes(spark, routers, parents, regs, **more):
    rows = [(k, r, fw, p, m, False, h, False, "a.go", k, 1) for k, (r, fw, p, m, h) in enumerate(regs)]
    return routes.route_facts(spark.createDataFrame(rows, REGS), spark.createDataFrame(routers, ROUTERS), spark.createDataFrame(parents, PARENTS), _vertices(spark, "h"), **more)


def test_mounts():
    assert routes.below_mount("", "/a") == [("/a", False)]
    assert routes.below_mount("/p/", "/a") == [("/p/a", False)]
    assert routes.below_mount("/p", "/") == [("/p/", False), ("/p", False)]
    assert routes.below_mount("/p", "/*") == [("/p/*", False), ("/p", True)]


def test_composition():
    step = lambda kind, prefix, dynamic=False: {"kind": kind, "prefix": prefix, "dynamic": dynamic}
    assert routes.compose("gin", "/x/", [step("gin", "/v1"), step("gin", "/api")], True).patterns == [("/api/v1/x/", False)]
    assert routes.compose("echo", "x", [step("echo", "/g")], True).patterns == [("/gx", False)]
    got = routes.compose("chi", "/a", [step("strip", "/s"), step("chi", "/p")], True)
    assert (got.anchor, got.strips, got.patterns) == ("base", ["/s"], [("/a", False)])
    assert routes.compose("chi", "/a", [step("chi", None, True)], True).anchor == "base"


def test_chains_follow_order_break_cycles_and_stop_at_the_limit(spark):
    routers = spark.createDataFrame([(r, False, None) for r in ("a", "b", "c", "x", "y", "m")], ROUTERS)
    edges = [("a", 0, "b", "chi", "/1", False), ("a", 1, None, "chi", "/2", False), ("a", 2, "c", "chi", "/3", False), ("x", 0, "y", "chi", "/x", False), ("y", 0, "x", "chi", "/y", False)]
    edges += [("m", k, "b", "chi", f"/{k}", False) for k in range(70)]
    got = routes.chains(routers, spark.createDataFrame(edges, PARENTS)).collect()
    ways = {r: sorted((w.top or "", [s.prefix for s in w.steps]) for w in got if w.router == r) for r in "abxm"}
    assert ways["a"] == [("", ["/2"]), ("b", ["/1"]), ("c", ["/3"])] and ways["b"] == [("b", [])]
    assert ways["x"] == [("y", ["/x"])]
    assert {w[1][0] for w in ways["m"]} == {f"/{k}" for k in range(64)} and all(w.more == (w.router == "m") for w in got)
    none = spark.createDataFrame([], ROUTERS)
    assert routes.chains(none, spark.createDataFrame([], PARENTS)).count() == 0


def test_facts(spark):
    routers = [("mux", False, None), ("e", False, None), ("g", False, None), ("sub", True, None)]
    parents = [("sub", 0, "g", "gin", "/api", False)]
    regs = [
        ("mux", "servemux", "GET /files/{rest...}", None, "h"),
        ("mux", "servemux", "GET /files/{$}", None, "h"),
        ("e", "echo", "/u/:id", ["GET"], "h"),
        ("e", "echo", "/v/:id", ["GET"], "lost"),
        ("e", "echo", "/v/:id/more", ["GET"], "h"),
        ("sub", "gin", "/p/:q", ["POST", "CONNECT"], "h"),
        (None, "chi", "/free", ["ANY"], "h"),
        ("g", "gin", "/open", None, "h"),
        ("g", "gin", None, ["GET"], "h"),
    ]
    got = _routes(spark, routers, parents, regs)
    rows = {(r.line, r.method, r.channel): r for r in got.facts.collect()}
    # The variant of the first pattern gives way to the route declared for it.
    assert (0, "GET", "/files/{**}") in rows and (0, "GET", "/files/") not in rows
    assert rows[2, "GET", "/u/{}"].slash == "optional" and rows[3, "GET", "/v/{}"].slash == "strict"
    assert rows[3, "GET", "/v/{}"].symbol is None and rows[2, "GET", "/u/{}"].symbol == "h"
    assert rows[5, "POST", "/api/p/{}"].slash == "optional" and (5, "CONNECT", "/api/p/{}") not in rows
    assert rows[6, "ANY", "/free"].anchor == "base"
    found, scopes = routes.limitations(got.gaps)
    assert {x["gap"]: x["count"] for x in found} == {"echo-leaf": 1, "method-not-constant": 1, "path-not-constant": 1, "prefix-unresolved": 1}
    assert {found[s["limitationIndex"]]["gap"]: {k: v for k, v in s.items() if k != "limitationIndex"} for s in scopes} == {"echo-leaf": {"templatePrefixes": ["/u/{}"], "methods": ["GET"]}, "method-not-constant": {"templates": ["/open"]}, "prefix-unresolved": {"templateSuffixes": ["/free"]}}
    assert routes.ordered_routes(got.facts).count() == len(rows)


def test_an_open_echo_path_leaves_the_closing_slash_unknown(spark):
    got = _routes(spark, [("e", False, None)], [], [("e", "echo", "/u/:id", ["GET"], "h"), ("e", "echo", None, ["GET"], "h")])
    assert [r.slash for r in got.facts.collect()] == [None]
    assert _routes(spark, [], [], []).facts.count() == 0


@pytest.mark.parametrize(
    "scope,problem",
    [({"templates": ["/a"]}, ""), ({}, "no templates, prefixes or suffixes"), ({"x": 1}, "unknown key"), ({"templates": []}, "templates: not a filled list"), ({"templates": ["a"]}, "templates: not a template"), ({"templatePrefixes": ["/{**}"]}, "templatePrefixes: catch-all"), ({"templatePrefixes": ["/a/"]}, "templatePrefixes: closing slash"), ({"templateSuffixes": ["/"]}, "templateSuffixes: bare slash"), ({"templates": ["/a"], "methods": ["ANY"]}, "methods: not a method"), ({"templates": ["/a"], "methods": ["GET", "GET"]}, "methods: repeated")],
)
def test_scopes(scope, problem):
    assert routes.scope_problem(scope) == problem
    assert routes.scope_prefix("/a/{**}") == "/a" and routes.scope_prefix("/{**}") == "/"


def test_documents():
    fact = {"method": "GET", "channel": "/a", "location": {"path": "a", "line": 1, "column": 1}}
    ordered = {**fact, "order": {"group": "g", "index": 0}}
    problem = lambda *facts, **more: routes.document_problem({"facts": list(facts), **more})
    assert problem(fact) == "" and problem({**fact, "method": "FETCH"}) == "fact 0: method"
    assert problem({**fact, "channel": "a"}) == "fact 0: template: not-rooted" and problem({**fact, "channel": "a", "dynamic": True}) == ""
    assert problem(ordered) == "fact 0: order without registration-order" and problem(ordered, dispatch="registration-order") == ""
    assert problem(ordered, {**ordered, "location": {"path": "b"}}, dispatch="registration-order") == "fact 1: order: one index for two places"
    assert problem({**fact, "order": {"group": " g", "index": 0}}, dispatch="registration-order") == "fact 0: order: group"
    assert problem({**fact, "order": {"group": "g", "index": 0.5}}, dispatch="registration-order") == "fact 0: order: index"
    below = {**fact, "symbol": {"usr": "h"}, "catchAllPrefix": True}
    assert problem(below) == "fact 0: catch-all prefix without its original"
    assert problem(below, {**fact, "symbol": {"usr": "h"}, "channel": "/a/{**}"}) == ""


WRAPPER = {"language": "go", "kind": "function", "owner": "m/api", "name": "Do", "pathArg": {"index": 1, "label": "path"}, "methodArg": {"index": 0}, "methodEnum": {"Fetch": "GET"}, "pathAnchor": "base"}


def _load(*found, **more):
    return wrappers.load_wrappers(json.dumps({"format": "http-wrappers", "version": 1, "wrappers": list(found), **more}))


def test_wrapper_files():
    assert _load(WRAPPER) == [WRAPPER]
    for bad in ({"odd": 1}, {"language": "c"}, {"kind": "x"}, {"owner": " "}, {"pathArg": {}}, {"pathArg": {"index": -1}}, {"methodArg": None}, {"defaultMethod": "get"}, {"pathAnchor": ""}, {"methodEnum": {"a": "ANY"}}):
        with pytest.raises(ValueError):
            _load({**WRAPPER, **bad})
    with pytest.raises(ValueError):
        _load(WRAPPER, version=2)


def test_wrapper_arguments():
    a, b = {"label": "verb", "enumCase": "Fetch"}, {"label": "path"}
    assert wrappers.bind({"index": 0, "label": "path"}, [a, b]) is b and wrappers.bind({"index": 0, "label": "other"}, [a]) is None
    assert wrappers.bind({"index": 2}, [a, b]) is None and wrappers.bind(None, [a]) is None
    assert wrappers.wrapper_method(WRAPPER, [a, b]) == "GET" and wrappers.wrapper_method(WRAPPER, [{"literal": "get"}]) == ""
    assert wrappers.wrapper_method(WRAPPER, [{"literal": "PUT"}]) == "PUT" and wrappers.wrapper_method({**WRAPPER, "defaultMethod": "POST"}, []) == "POST"


def test_client_facts(spark):
    arg = "label string, enumCase string, literal string, parts array<struct<kind:string,text:string>>"
    schema = f"owner string, callee_owner string, callee_name string, arguments array<struct<{', '.join(x.replace(' ', ':', 1) for x in arg.split(', '))}>>, path string, line int, column int"
    path = ("path", None, None, [("lit", "/u/"), ("val", None)])
    calls = [("f", "m/api", "Do", [("m", "Fetch", None, None), path], "a.go", 1, 1), ("f", "m/api", "Do", [], "a.go", 2, 1), ("f", "m/api", "Other", [], "a.go", 3, 1)]
    got = wrappers.wrapper_calls(spark.createDataFrame(calls, schema), [WRAPPER])
    rows = {r.line: r for r in got.collect()}
    assert (rows[1].method, rows[1].channel, rows[1].anchor) == ("GET", "/u/{}", "base") and not rows[2].bound and len(rows) == 2
    known = spark.createDataFrame([("m/api", "Do")], "owner string, name string")
    assert [r.gap for r in wrappers.wrapper_gaps(got, [WRAPPER], known).collect()] == ["path-not-bound"]
    assert [r.gap for r in wrappers.wrapper_gaps(got, [WRAPPER], known.where("false")).collect()] == ["no-declaration"]
    flags = {"unresolved": F.lit(False), "parameter": F.lit(False), "from_wrapper": F.lit(True)}
    all_calls = got.where("bound").withColumns(flags)
    direct = all_calls.withColumns({"from_wrapper": F.lit(False), "dynamic": F.lit(True), "parameter": F.lit(True)})
    inner, outer = direct.withColumn("owner", F.lit("w")), direct.withColumn("owner", F.lit("z"))
    facts, counts = wrappers.client_facts(all_calls.union(all_calls).union(inner).union(outer), spark.createDataFrame([("w",)], "owner string"), _vertices(spark, "f"))
    assert sorted((r.symbol or "", r.dynamic) for r in facts.collect()) == [("", True), ("f", False)]
    assert counts.first().asDict() == {"missing_symbols": 1, "unresolved_bases": 0, "ambiguous_joins": 0, "undeclared_wrappers": 1}


def test_commands_over_fact_tables(spark, tmp_path):
    from edgewise.commands import Session
    from edgewise.graph import EDGE, VERTEX, graph

    vertex = {"id": "h", "kind": "func", "name": "h"}
    g = graph(spark.createDataFrame([tuple(vertex.get(n) for n in VERTEX.names)], VERTEX), spark.createDataFrame([], EDGE))
    session = Session(g)

    def saved(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return str(tmp_path / name)

    got = session.routes(saved("regs", [(1, "g", "gin", "/a", ["GET"], False, "h", False, "a.go", 1, 1)], REGS), saved("routers", [("g", False, "strict")], ROUTERS), saved("parents", [], PARENTS))
    assert [(f["channel"], f["slash"], f["symbol"]) for f in got["facts"]] == [("/a", "strict", "h")] and got["limitations"] == []
    unused = session.unused_deps(saved("requires", [("m/a", False), ("m/b", True)], "module string, indirect boolean"), saved("imports", [("m/a/x", None)], "path string, module string"))
    assert [x["module"] for x in unused["unused"]] == ["m/b"]
    assert session.schema(saved("texts", [("SELECT * FROM t",)], "text string"))["facts"][0]["relations"] == ["t"]
    calls = [("h", "m/api", "Do", [("path", None, "/x", [("lit", "/x")]), ("path", None, "/x", [("lit", "/x")])], "a.go", 1, 1)]
    schema = "owner string, callee_owner string, callee_name string, arguments array<struct<label:string,enumCase:string,literal:string,parts:array<struct<kind:string,text:string>>>>, path string, line int, column int"
    (tmp_path / "w.json").write_text(json.dumps({"format": "http-wrappers", "version": 1, "wrappers": [{**WRAPPER, "methodArg": None, "defaultMethod": "GET"}]}))
    got = session.bridges(saved("calls", calls, schema), str(tmp_path / "w.json"), saved("declared", [("m/api", "Do", "m/api.Do")], "owner string, name string, id string"))
    assert [(f["method"], f["channel"], f["symbol"]) for f in got["facts"]] == [("GET", "/x", "h")] and got["wrappers"] == [] and got["counts"]["missing_symbols"] == 0
