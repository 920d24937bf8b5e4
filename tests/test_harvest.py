"""What a harvest says about itself: modules, pattern errors, omissions, symbols, captures."""

from edgewise import graph as G
from edgewise.sources import harvest

PACKAGES = "id string, name string, module string, module_dir string, main boolean, n_files int, errors array<string>"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_workspace_modules_need_two_main_modules(spark):
    own = [("m/a", "a", "m", "/m", True, 1, None), ("m/b", "b", "m", "/m", True, 1, None), ("x/y", "y", "x", "/x", False, 1, None)]
    modules, packages = harvest.workspace_modules(spark.createDataFrame(own, PACKAGES), "m")
    assert rows(modules) == rows(packages) == set()
    two = [*own, ("n/c", "c", "n", "/n", True, 1, None)]
    modules, packages = harvest.workspace_modules(spark.createDataFrame(two, PACKAGES), "m")
    assert rows(modules) == {("m", "/m"), ("n", "/n")} and rows(packages) == {("n/c", "n")}


def test_pattern_errors_are_no_packages(spark):
    p = [("./b", None, None, None, False, 0, ["  no module provides b; to add it:\n\tget b"]), ("./a", "", None, None, False, None, ["cannot find a:\nelse"]), ("c", "c", "m", "/m", True, 2, ["broken"]), ("d", None, None, None, False, 3, ["x"]), ("e", None, None, None, False, 0, [])]
    kept, errors = harvest.pattern_errors(spark.createDataFrame(p, PACKAGES))
    assert {r.id for r in kept.collect()} == {"c", "d", "e"} and rows(errors) == {("./b", "no module provides b"), ("./a", "cannot find a")}
    assert rows(harvest.pattern_limitation(spark.createDataFrame(p, PACKAGES))) == {(2, "cannot find a", False)}
    assert rows(harvest.pattern_limitation(spark.createDataFrame(p[:1], PACKAGES))) == {(1, "no module provides b", True)}
    assert rows(harvest.pattern_limitation(spark.createDataFrame(p[2:], PACKAGES))) == set()


def test_omissions_count_packages_and_targets_once(spark):
    p = [("a", "a", True, False, 2, True), ("a [a.test]", "a", True, False, 2, True), ("b", "b", True, False, 0, False), ("x", "x", False, True, 5, True), ("fmt", "fmt", False, False, 0, False)]
    i = [("a", "fmt"), ("a [a.test]", "fmt"), ("a", "b"), ("b", "x"), ("b", "gone"), ("x", "fmt")]
    out = harvest.omissions(spark.createDataFrame(p, "id string, package string, kept boolean, excluded boolean, ignored int, failed boolean"), spark.createDataFrame(i, "src string, dst string"))
    assert rows(out) == {("imports outside the module", 2), ("imports of excluded packages", 1), ("packages with load errors", 1), ("files of other builds", 2), ("test variants merged", 1)}


def test_symbols_have_places_inside_the_project_alone(spark):
    at = lambda f, line=3, c=2: {"file": f, "line": line, "column": c}
    v = [{"id": "m/p.F", "kind": "func", "position": at("/w/app/p/f.go")}, {"id": "m/p.G", "kind": "var", "position": at("/w/doc/g.go", 1, -5)}, {"id": "m/p.H", "kind": "func", "position": at("/w/apps/h.go")}, {"id": "m/p.I", "kind": "func", "position": at("/w/app/../i.go")}, {"id": "m/p.J", "kind": "func", "position": at("/w/app/j.go", 0)}, {"id": "m/p.K", "kind": "type"}]
    g = G.from_rows(spark, v, [("m/p.F", "m/p.G", "call")], root="/w/doc")
    ids = spark.createDataFrame([(x["id"],) for x in v] + [("none",)], "id string")
    got = {r.id: (r.usr, r.qualified_name, r.kind, r.path, r.line, r.column) for r in harvest.symbols_of(g, ids, "/w/app/").collect()}
    assert got["m/p.F"] == ("m/p.F", "p.F", "func", "p/f.go", 3, 2) and got["m/p.G"][3:] == ("g.go", 1, 0) and got["none"] == (None,) * 6
    assert all(got[f"m/p.{x}"][3:] == (None, None, None) for x in "HIJK") and got["m/p.K"][2] == "type"


def test_captures_differ_where_their_files_do(spark):
    files = [("a.go", "m", "1"), ("d/b.go", "m", "2"), ("d/e/c.go", "m", "3"), ("f/x", "m", "4")]
    kind = "file string, mode string, sha256 string"
    one = spark.createDataFrame(files, kind)
    other = spark.createDataFrame([("a.go", "m", "1"), ("d/b.go", "x", "2"), ("d/e/c.go", "m", "3"), ("g/x", "m", "4")], kind)
    tree = {r.folder: (r.files, r.digest) for r in harvest.capture_tree(one).collect()}
    assert {k: n for k, (n, _) in tree.items()} == {"": 4, "d": 2, "d/e": 1, "f": 1}
    again = {r.folder: (r.files, r.digest) for r in harvest.capture_tree(spark.createDataFrame(files[::-1], kind).repartition(3)).collect()}
    assert again == tree and tree["d/e"] == {r.folder: (r.files, r.digest) for r in harvest.capture_tree(other).collect()}["d/e"]
    assert rows(harvest.differing_folders(one, other)) == {("d", "changed"), ("f", "removed"), ("g", "added")} and rows(harvest.differing_folders(one, one)) == set()
