"""Hand-made documents with known answers, and random ones against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from edgewise import graph as G
from edgewise.operators import cycles, diff, queries, rules, traversal
from edgewise.operators.reach import bucketed, discover, index, reachable, step


def doc(spark, edges, ids=None, kinds=None, **meta):
    ids = ids or sorted({x for e in edges for x in e[:2]})
    rows = [{"id": i, "kind": (kinds or {}).get(i, "func"), "name": i.rsplit(".", 1)[-1]} for i in ids]
    return G.from_rows(spark, rows, edges, **meta)


CYCLE = [("a", "b", "import"), ("b", "c", "import"), ("c", "a", "import"), ("d", "a", "import"), ("e", "e", "import")]


def test_cycles(spark):
    g = doc(spark, CYCLE)
    found = {tuple(r) for r in cycles.cycles(g).collect()}
    assert found == {("a", "a"), ("a", "b"), ("a", "c"), ("e", "e")}
    assert cycles.evidence(g, cycles.cycles(g)).count() == 4


def test_query(spark):
    g = doc(spark, [*CYCLE, ("a", "b", "call")])
    got = {(r.direction, r.id): r.kinds for r in queries.query(g, "a", 1).collect()}
    assert got == {("dependsOn", "b"): ["call", "import"], ("dependedBy", "c"): ["import"], ("dependedBy", "d"): ["import"]}
    capped = queries.query(g, "a", 3, 1).where("direction = 'dependsOn'").collect()
    assert [r.id for r in capped] == ["b"]
    with pytest.raises(queries.NotFound):
        queries.query(g, "nowhere")


def test_path_and_ownership(spark):
    g = doc(spark, [*CYCLE, ("d", "x", "contains")], ids=["a", "b", "c", "d", "e", "x"])
    assert [r.id for r in queries.path(g, "d", "c").collect()] == ["d", "a", "b", "c"]
    assert queries.path(g, "a", "a").count() == 1
    assert queries.path(g, "d", "x").count() == 0


def test_impact(spark):
    g = doc(spark, [("pkg.a", "pkg.b", "call"), ("pkg.b", "pkg.c", "call"), ("pkg.b", "pkg.c", "references"), ("pkg", "pkg.c", "contains")])
    got = {r.id: (r.depth, r.kinds) for r in queries.impact(g, ["pkg.c"]).collect()}
    assert got == {"pkg.b": (1, ["call", "references"]), "pkg.a": (2, ["call"])}
    assert queries.depth_limited(g, ["pkg.c"], 1) and not queries.depth_limited(g, ["pkg.c"], 2)


def test_shared(spark):
    g = doc(spark, [("m/a", "m/common", "import"), ("m/a", "m/onlya", "import"), ("m/b", "m/common", "import")])
    got = {r.id: (r.roots, r.n) for r in queries.shared(g, ["m/a", "m/b"]).collect()}
    assert got["m/common"] == ([0, 1], 2) and got["m/onlya"] == ([0], 1) and got["m/a"] == ([0], 1)


def test_dead(spark):
    rows = [
        {"id": "p", "kind": "package"}, {"id": "p.main", "kind": "func"}, {"id": "p.f", "kind": "func"}, {"id": "p.Dead", "kind": "func", "exported": True},
        {"id": "p.gone", "kind": "func"}, {"id": "p.T", "kind": "type"}, {"id": "p.(T).Error", "kind": "method", "satisfies": ["error"], "receiver": "p.T"},
    ]
    g = G.from_rows(spark, rows, [("p", "p.main", "contains"), ("p", "p.f", "contains"), ("p.main", "p.f", "call"), ("p.f", "p.T", "references")], roots=["p.main"])
    assert {r.id for r in queries.unreachable(g).collect()} == {"p.Dead", "p.gone"}
    assert {r.id for r in queries.unreachable(g, public=True).collect()} == {"p.gone"}
    roots, unknown = queries.retention_roots(g, extra=["p.gone", "nope"])
    assert {r.id for r in roots.collect()} == {"p.main", "p.gone"} and unknown == ["nope"]
    assert [r.id for r in queries.explain(g, "p.(T).Error", roots).collect()] == ["p.main", "p.f", "p.T", "p.(T).Error"]
    assert [tuple(r)[:2] for r in queries.external_hops(g).collect()] == [("p.T", "p.(T).Error")]


def test_dead_rta_asks_live_callers_of_interface_methods(spark):
    rows = [{"id": "p.I", "kind": "type", "interface": True}, {"id": "p.(I).M", "kind": "method"}, {"id": "p.(I).N", "kind": "method"}, {"id": "p.main", "kind": "func"}, {"id": "p.x", "kind": "func"}, {"id": "p.v", "kind": "var"}]
    g = G.from_rows(spark, rows, [("p.main", "p.(I).M", "call"), ("p.x", "p.(I).N", "call")])
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {r.id for r in queries.dead_rta(g, ids("p.main", "p.I"), ids("p.main")).collect()}
    assert got == {"p.(I).N", "p.x", "p.v"}


@pytest.mark.parametrize(
    "edges,roots,dependents,expected",
    [
        ([("B", "A", "call"), ("C", "B", "call")], ["A", "B"], True, {"B": ("A", 1, [0]), "C": ("B", 1, [0, 1])}),
        ([("A", "W", "call"), ("W", "V", "call"), ("V", "R", "call"), ("R", "V", "call")], ["A", "R"], False, {"W": ("A", 1, [0]), "V": ("R", 1, [0, 1]), "R": ("V", 3, [0])}),
        ([("A", "B", "call"), ("B", "A", "call")], ["A"], False, {"B": ("A", 1, [0])}),
    ],
)
def test_traverse(spark, edges, roots, dependents, expected):
    out, reasons = traversal.traverse(doc(spark, edges), roots, dependents)
    assert {r.id: (r.via, r.depth, r.roots) for r in out.collect()} == expected and reasons == []


def test_traverse_truncation_and_evidence(spark):
    edges = [("a", "b", "call"), ("b", "c", "call"), ("c", "d", "call", True)]
    out, reasons = traversal.traverse(doc(spark, edges), ["a"], depth=2, limit=1)
    assert reasons == ["depth", "max-reached"] and [r.id for r in out.collect()] == ["b"] and out.first().evidence is None
    out, _ = traversal.traverse(doc(spark, edges, dispatchEvidence=True), ["a"])
    assert {r.id: r.evidence for r in out.collect()} == {"b": "direct", "c": "direct", "d": "candidate"}


def search(pairs, roots, depth=None):
    """Breadth-first search of one key in discovery order: id, depth, parent."""
    seen, out, frontier, level = set(roots), [(x, 0, None) for x in sorted(roots)], sorted(roots), 0
    while frontier and level != depth:
        level, after = level + 1, []
        for x in frontier:
            for y in sorted(b for a, b in pairs if a == x):
                if y not in seen:
                    seen.add(y)
                    after.append(y)
                    out.append((y, level, x))
        frontier = after
    return out


def random_pairs(rng, n, m):
    return list({(f"v{rng.randrange(n):02d}", f"v{rng.randrange(n):02d}") for _ in range(m)})


def test_searches_equal_brute_force(spark):
    rng = random.Random(7)
    pairs = random_pairs(rng, 25, 45)
    df = index(spark.createDataFrame(pairs, "src string, dst string"))
    roots = {0: {pairs[0][0]}, 1: {pairs[1][0], pairs[2][0]}, 2: {"nowhere"}}
    start = spark.createDataFrame([(k, x) for k, ids in roots.items() for x in ids], "key int, id string")
    for depth in (None, 1, 2):
        found = discover(df, start, depth).orderBy("key", "depth", "rank").collect()
        for k, ids in roots.items():
            assert [(r.id, r.depth, r.parent) for r in found if r.key == k] == search(pairs, ids, depth)
    for k in (0, 1):
        one = start.where(F.col("key") == k).select("id")
        assert {r.id for r in reachable(df, one).collect()} == {x for x, _, _ in search(pairs, roots[k])}
    assert discover(df, start, ranked=False).where("rank is not null").isEmpty()


def test_long_ways_append_a_level_a_step(spark):
    pairs = [(f"v{k:02d}", f"v{k + 1:02d}") for k in range(30)]
    found = discover(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([(0, "v00")], "key int, id string"), ranked=False)
    assert {(r.id, r.depth) for r in found.collect()} == {(f"v{k:02d}", k) for k in range(31)}


def test_levels_do_not_move_the_index(spark):
    """The plan of a level has no exchange on the side of the edges."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = index(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"))
        now = bucketed(spark.createDataFrame([(0, "a", 0, None)], "key int, id string, depth int, rank long"), "level", "key", "id")
        plan = step(edges, now)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # two exchanges: of the frontier, and of what it finds
    assert plan.count("Exchange") == 2 and plan.count("Bucketed: true") >= 1
    scan = plan[plan.index("edgewise_pairs") - 400 : plan.index("edgewise_pairs")]
    assert "Exchange" not in scan


def members_of(pairs):
    reach = {x: {y for y, _, _ in search(pairs, {b for a, b in pairs if a == x})} for p in pairs for x in p}
    return {(min(y for y in reach[x] if x in reach[y]), x) for x in reach if x in reach[x]}


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    for n, m in ((12, 14), (30, 36), (20, 50)):
        pairs = random_pairs(rng, n, m)
        assert {tuple(r) for r in cycles.components(spark.createDataFrame(pairs, "src string, dst string")).collect()} == members_of(pairs)
    # a ring inside a chain that closes, beside one that does not, and a loop at the end of a chain
    pairs = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "a"), ("e", "f"), ("f", "e"), ("f", "g"), ("g", "h"), ("h", "h"), ("h", "i")]
    assert {tuple(r) for r in cycles.components(spark.createDataFrame(pairs, "src string, dst string")).collect()} == members_of(pairs)


def test_a_ring_of_ten_thousand_takes_a_logarithm_of_steps(spark):
    ring = spark.range(10_000).selectExpr("lpad(id, 5, '0') AS src", "lpad((id + 1) % 10000, 5, '0') AS dst")
    tail = spark.range(3_000).selectExpr("concat('t', lpad(id, 5, '0')) AS src", "CASE WHEN id = 2999 THEN '00007' ELSE concat('t', lpad(id + 1, 5, '0')) END AS dst")
    began = time.perf_counter()
    got = cycles.components(ring.union(tail))
    assert got.count() == 10_000 and got.select("component").distinct().collect()[0][0] == "00000"
    assert time.perf_counter() - began < 90


def multi_root(edges, roots, depth):
    """Rows (id, depth, via, roots, relationships, evidence, truncated) and whether the depth cuts something off, by a search a root."""
    pairs = {(a, b) for a, b, *_ in edges}
    sure = {(a, b) for a, b, _, candidate in edges if not candidate}
    utf16 = lambda x: x.encode("utf-16-be")
    full = [{x: d for x, d, _ in search(pairs, {r}, depth + 1)} for r in roots]
    direct = [{x: d for x, d, _ in search(sure, {r}, depth)} for r in roots]
    out, cut = {}, False
    for id in {x for f in full for x in f}:
        others = [k for k, f in enumerate(full) if id in f and roots[k] != id]
        held = [k for k in others if full[k][id] <= depth]
        # a root one step off changes the row only where fewer than 65 smaller ones are there already
        cut |= any(sum(x < k for x in held) < 65 for k in others if full[k][id] == depth + 1)
        if held:
            d, k = min((full[k][id], k) for k in held)
            via = min((a for a, b in pairs if b == id and full[k].get(a) == d - 1), key=utf16)
            kinds = sorted({kind for a, b, kind, _ in edges if (a, b) == (via, id)})
            out[id] = (d, via, held[:64], kinds, "direct" if all(id in direct[k] for k in held) else "candidate", len(held) > 64)
    return out, cut


@pytest.mark.parametrize("n,m,k,depth", [(12, 25, 4, 2), (40, 90, 8, 128), (90, 260, 80, 3), (90, 300, 75, 2)])
def test_traverse_equals_a_search_a_root(spark, n, m, k, depth):
    rng = random.Random(n * depth)
    names = ["a", "Z", "é", "\U0001f600", "\ue000", "a/b.(T).M"]
    ids = [f"{rng.choice(names)}{j}" for j in range(n)]
    edges = [(rng.choice(ids), rng.choice(ids), rng.choice(["call", "references", "signature"]), rng.random() < 0.3) for _ in range(m)]
    roots = rng.sample(ids, k)
    roots.insert(1, "missing")
    expected, cut = multi_root(edges, roots, depth)
    out, reasons = traversal.traverse(doc(spark, edges, dispatchEvidence=True), roots, depth=depth)
    got = {r.id: (r.depth, r.via, r.roots, r.relationships, r.evidence, r.roots_truncated) for r in out.collect()}
    assert got == expected and reasons == ["depth"] * cut


def test_depth_is_no_reason_where_smaller_roots_decide(spark):
    """69 roots call m, the last one calls x and x calls m: at depth 1 nothing is cut off that a row would show."""
    edges = [(f"r{k:02d}", "m", "call") for k in range(69)] + [("r69", "x", "call"), ("x", "m", "call")]
    out, reasons = traversal.traverse(doc(spark, edges), [f"r{k:02d}" for k in range(70)], depth=1)
    rows = {r.id: r for r in out.collect()}
    assert reasons == [] and rows["m"].roots == list(range(64)) and rows["m"].roots_truncated and rows["x"].roots == [69]
    few = [e for e in edges if e[0] in ("r00", "r69", "x")]
    assert traversal.traverse(doc(spark, few), ["r00", "r69"], depth=1)[1] == ["depth"]


def test_a_vertex_takes_in_few_roots_a_level(spark):
    edges = index(spark.createDataFrame([(f"r{k:03d}", "hub") for k in range(200)] + [("hub", "r000"), ("hub", "end")], "src string, dst string"))
    start = spark.createDataFrame([(k, f"r{k:03d}") for k in range(200)], "key int, id string")
    state, cut = traversal.spread_roots(edges, start, 5)
    held = {r.id: [h.root for h in r.held] for r in state.collect()}
    assert held["hub"] == list(range(66)) and held["end"] == list(range(66)) and held["r000"] == list(range(66)) and not cut


def metrics_doc(spark, **meta):
    m = "example.com/m"
    rows = [{"id": f"{m}/{x}", "kind": "package", "name": x} for x in ("web", "svc", "db", "util")] + [{"id": m, "kind": "package", "name": "main"}]
    edges = [(f"{m}/web", f"{m}/svc", "import"), (f"{m}/svc", f"{m}/db", "import"), (m, f"{m}/web", "import")]
    return G.from_rows(spark, rows, edges, module=m, level="package", **meta)


def test_metrics_and_orphans(spark):
    g = metrics_doc(spark)
    got = {r.name.rsplit("/", 1)[-1]: (r.ca, r.ce, r.instability, r.abstractness) for r in rules.metrics(g).collect()}
    assert got["web"] == (1, 1, 0.5, None) and got["db"] == (1, 0, 0.0, None) and got["util"] == (0, 0, None, None)
    assert [r.id for r in rules.orphans(g).collect()] == ["example.com/m/util"]


def test_rules(spark):
    g = metrics_doc(spark)
    r = rules.validate(rules.Rules(components={"web": ["web"], "svc": ["svc/**"], "db": ["d*"], "empty": ["none"]}, deps={"web": ["svc"]}, stability=True, limits=[{"component": "db", "maxIn": 0}], forbidden=[{"from": "web", "to": "db"}]))
    got = [(v.rule, v.fromComponent, v.toComponent, v.path) for v in rules.ordered(rules.check(g, r)).collect()]
    m = "example.com/m"
    assert ("allow", "svc", "db", None) in got and ("limit", "", "db", None) in got
    assert ("forbidden", "web", "db", [f"{m}/web", f"{m}/svc", f"{m}/db"]) in got and len(got) == 3
    assert rules.unmatched_components(g, r) == ["empty"]
    assert rules.scaffold(g).deps == {"root": ["web"], "db": [], "svc": ["db"], "util": [], "web": ["svc"]}
    for bad in (dict(deps={"x": []}), dict(components={"a": ["a/**/b"]}), dict(components={"a": ["a"]}, limits=[{"component": "a", "maxIn": -1}])):
        with pytest.raises(ValueError):
            rules.validate(rules.Rules(**bad))


def test_diff(spark):
    row = lambda i, k="func": {"id": i, "kind": k, "name": i.rsplit(".", 1)[-1], "exported": True}
    old = G.from_rows(spark, [{"id": "m/a", "kind": "package"}, row("m/a.F"), row("m/a.gone"), row("m/a.T", "type"), row("m/a.U", "type")], [("m/a.F", "m/a.T", "signature"), ("m/a.gone", "m/a.U", "signature")])
    new = G.from_rows(spark, [{"id": "m/a", "kind": "package"}, row("m/a.F"), row("m/a.NEW"), row("m/a.T", "type"), row("m/a.U", "type")], [("m/a.F", "m/a.U", "signature"), ("m/a.F", "m/a.T", "signature")])
    assert {tuple(r) for r in diff.vertex_diff(old, new).collect()} == {("m/a.NEW", "added"), ("m/a.gone", "removed")}
    assert [tuple(r) for r in diff.signature_diff(old, new).collect()] == [("m/a.F", ["m/a.U"], [])]
    assert {r.change for r in diff.edge_diff(old, new).collect()} == {"added", "removed"}
    assert [r.message for r in diff.breaking(old, new).collect()] == ["gone: m/a.gone"]


def test_field_changes(spark):
    t = lambda f: G.from_rows(spark, [{"id": "p.T", "kind": "type", "exported": True, "fields": f}], [])
    old, new = t(["A:int", "B:string", "C:x"]), t(["B:int", "A:int", "D:y"])
    assert [tuple(r) for r in diff.field_changes(old, new).collect()] == [("p.T", ["D"], ["C"], ["B"], True)]
    text = [r.message for r in diff.breaking(old, new).orderBy("phase", "key", "seq").collect()]
    assert text[0] == "field gone: p.T.C" and "B: was string, is int" in text[1] and "without field names" in text[2]


def test_baseline_is_a_multiset(spark):
    f = lambda rows: spark.createDataFrame(rows, "key string, ord int")
    out = diff.split_baseline(f([("a", 1), ("a", 2), ("b", 3)]), f([("a", 1), ("c", 2), ("c", 3)]))
    assert sorted(map(tuple, out.collect())) == [("a", 1, "baselined"), ("a", 2, "fresh"), ("b", 3, "fresh"), ("c", 2, "stale"), ("c", 3, "stale")]


def test_normalize_and_view(spark):
    p = lambda n: ("f", n, None)
    e = spark.createDataFrame([("a", "b", "call", [p(2), p(1)], True), ("a", "b", "call", [p(1)], False)], G.EDGE)
    v = spark.createDataFrame([("a", "func"), ("b", "func"), ("q", "package")], "id string, kind string")
    g = G.normalize(G.graph(v, e))
    row = g.edges.first()
    assert [x.line for x in row.positions] == [1, 2] and row.positions[0].column == 0 and row.candidate is False
    assert G.view(g, "symbol").vertices.count() == 2 and G.view(g, "package").edges.count() == 0
    with pytest.raises(ValueError):
        G.require_level(g, "module")


def test_member_edges(spark):
    rows = [{"id": "p.T", "kind": "type", "fields": ["F:*q.X", "G:q.XY"]}, {"id": "p.(T).F", "kind": "field", "name": "F"}, {"id": "p.(T).G", "kind": "field", "name": "G"}, {"id": "q.X", "kind": "type"}]
    got = {tuple(r)[:2] for r in traversal.member_edges(G.from_rows(spark, rows, [("p.T", "q.X", "references")])).collect()}
    assert got == {("p.(T).F", "q.X")}


def test_files(spark):
    rows = [{"id": "m/a.f", "kind": "func", "package": "m/a", "name": "TestF", "position": ("/r/a/x_test.go", 1, 1)}, {"id": "m/a", "kind": "package"}, {"id": "m/b.g", "kind": "func"}]
    g = G.from_rows(spark, rows, [("m/b.g", "m/a.f", "call")], root="/r")
    files = spark.createDataFrame([("a/x_test.go",), ("README.md",)], "file string")
    hit, lost = queries.vertices_of_files(g, files)
    assert {r.id for r in hit.collect()} == {"m/a.f", "m/a"} and [r.file for r in lost.collect()] == ["README.md"]
    got = {r.id: (r.depth, r.via, r.test_candidate) for r in queries.change_candidates(g, files).collect()}
    assert got == {"m/a.f": (0, [], True), "m/a": (0, [], False), "m/b.g": (1, ["m/a.f"], False)}
    a = spark.createDataFrame([("x", "644", "1"), ("y", "644", "2")], "file string, mode string, sha256 string")
    b = spark.createDataFrame([("x", "755", "1"), ("z", "644", "2")], "file string, mode string, sha256 string")
    assert {r.file for r in queries.changed_files(a, b).collect()} == {"x", "y", "z"}


def test_column_helpers(spark):
    from edgewise.functions import ids

    row = spark.range(1).select(
        ids.member_owner(F.lit("p/q.(T).M")), ids.member_owner(F.lit("p.F")), ids.canonical_id(F.lit("p#symbol")), ids.significant(F.lit(0.5)), ids.significant(F.lit(0.6667)),
        ids.match_path("a/*/c", F.lit("a/x/c")), ids.match_path("a/**", F.lit("a")), ids.match_path("a/**", F.lit("ab")), ids.match_file("!*.go", F.lit("d/x.go")), ids.significant(F.lit(0.00001234)),
    ).first()
    assert list(row) == ["p/q.T", None, "p", "0.5", "0.667", True, True, False, False, "1.23e-05"]


def test_mapping_picks_the_longest_pattern(spark):
    paths = ["a", "a/b", "a/b/c", "a/x/c", "b", "deep/er/x", "deep/er", "zz", "q/r", ".", "ab"]
    r = rules.Rules(components={"exact": ["a/b"], "tree": ["a/**"], "glob": ["a/*/c", "*/r"], "deep": ["deep/**"], "deeper": ["deep/er/**"], "same2": ["b"], "same1": ["b"], "dot": ["."]})
    got = {x.path: x.component for x in rules.components_of(spark.createDataFrame([(p,) for p in paths], "path string"), r).collect()}
    assert got == {"a": "tree", "a/b": "tree", "a/b/c": "glob", "a/x/c": "glob", "b": "same1", "deep/er/x": "deeper", "deep/er": "deeper", "q/r": "glob", ".": "dot"}


def test_mapping_of_as_many_components_as_packages(spark):

    n = 20_000
    v = spark.range(n).select(F.format_string("m/d%d/p%d", F.col("id") % 97, "id").alias("id"), F.lit("package").alias("kind"), F.lit("p").alias("name"))
    g = G.graph(v, spark.createDataFrame([], G.EDGE), G.Meta(module="m", level="package"))
    r = rules.Rules(components={f"c{k}": [f"d{k % 97}/p{k}/**"] for k in range(n)})
    began = time.perf_counter()
    m = rules.mapping(g, r)
    assert m.where("component = concat('c', regexp_extract(path, 'p([0-9]+)$', 1))").count() == n
    assert rules.metrics(g, r).where("size(packages) = 1").count() == n
    assert time.perf_counter() - began < 60


def test_reach_rules_take_one_search(spark):
    ids = ["m/a", "m/b", "m/c", "m/d"]
    g = G.from_rows(spark, [{"id": i, "kind": "package", "name": i} for i in ids], [("m/a", "m/b", "import"), ("m/b", "m/c", "import"), ("m/a", "m/d", "import"), ("m/d", "m/c", "import")], module="m", level="package")
    r = rules.Rules(components={"A": ["a"], "B": ["b"], "C": ["c"], "D": ["d"]}, forbidden=[{"from": "A", "to": "C"}, {"from": "C", "to": "A"}], independent=["B", "D", "C"])
    got = {(x.rule, x.fromComponent, x.toComponent): x.path for x in rules.reach_violations(g, r).collect()}
    assert got == {("forbidden", "A", "C"): ["m/a", "m/b", "m/c"], ("independence", "B", "C"): ["m/b", "m/c"], ("independence", "D", "C"): ["m/d", "m/c"]}
    assert rules.reach_violations(g, rules.Rules(components={"A": ["a"]})).count() == 0
