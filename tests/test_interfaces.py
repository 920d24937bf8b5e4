"""Interface changes: gains, losses and what they come through."""

from edgewise import graph as G
from edgewise.operators import diff


def iface(id, exported=True, methods=None):
    return {"id": id, "kind": "type", "name": id.rsplit(".", 1)[1], "package": "m/a", "interface": True, "exported": exported, "methods": methods}


def method(id):
    return {"id": id, "kind": "method", "name": id.rsplit(".", 1)[1], "package": "m/a", "exported": True}


def changes(spark, old, new, edges=((), ()), **meta):
    a, b = (G.from_rows(spark, v, list(e) or [("x", "y", "call")], **meta) for v, e in zip((old, new), edges))
    return {tuple(r) for r in diff.interface_changes(a, b).collect()}, [r.message for r in diff.breaking(a, b).orderBy("phase", "key", "seq", "message").collect()]


def test_gained_methods_without_method_sets(spark):
    old = [iface("m/a.I"), method("m/a.(I).Do")]
    new = [*old, method("m/a.(I).Run"), iface("m/a.J"), method("m/a.(J).New")]
    got, says = changes(spark, old, new)
    assert got == {("m/a.I", "Run", "gained", "declared", None, None)} and says == ["interface m/a.I: method Run gained"]


def test_gains_through_embedding_reach_all_embedders(spark):
    vs = [iface("m/a.I"), iface("m/a.H"), iface("m/a.j", False), method("m/a.(j).M"), iface("m/a.K"), method("m/a.(K).Z")]
    embeds = [("m/a.I", "m/a.j", "embeds"), ("m/a.H", "m/a.I", "embeds"), ("m/a.j", "m/a.H", "embeds")]
    got, _ = changes(spark, vs, [*vs, method("m/a.(j).N")], (embeds, embeds))
    assert got == {("m/a.I", "N", "gained", "embedded", "m/a.j", "m/a.j"), ("m/a.H", "N", "gained", "embedded", "m/a.j", "m/a.j")}
    more = [*embeds[:1], ("m/a.I", "m/a.K", "embeds"), ("m/a.j", "m/a.K", "embeds"), ("m/a.L", "m/a.K", "embeds"), ("m/a.I", "gone.X", "embeds")]
    got, says = changes(spark, vs, [*vs, iface("m/a.L")], (embeds[:1], more))
    assert got == {("m/a.I", None, "embeds", "embedded", "m/a.K", "m/a.K")} and says == ["interface m/a.I embeds m/a.K now"]


def test_method_sets_tell_declared_from_embedded(spark):
    facts = {"interfaceMethodSets": True, "level": "symbol"}
    old = [iface("m/a.I", True, ["Do()"]), method("m/a.(I).Do"), iface("m/a.Any"), iface("m/a.p", False, ["Do()"])]
    new = [iface("m/a.I", True, ["Do() error", "Read([]byte) (int, error)"]), method("m/a.(I).Do"), iface("m/a.Any", True, ["String() string"]), iface("m/a.p", False, ["Read()"])]
    got, says = changes(spark, old, new, **facts)
    assert got == {("m/a.Any", "String", "gained", "embedded", None, None), ("m/a.I", "Do", "changed", "declared", None, None), ("m/a.I", "Read", "gained", "embedded", None, None)}
    assert says == ["interface m/a.Any: method String gained by embedding", "interface m/a.I: method Do changed", "interface m/a.I: method Read gained by embedding"]
    assert changes(spark, old, old, **facts)[0] == set()


def test_method_sets_name_both_the_embedded_and_the_declaring_interface(spark):
    facts = {"interfaceMethodSets": True, "level": "symbol"}
    old = [iface("m/a.I", True, ["Keep()", "Lost()", "Own()"]), method("m/a.(I).Own"), iface("m/a.J", True, ["Keep()", "Lost()"]), iface("m/a.B", True, ["Keep()", "Lost()"]), method("m/a.(B).Keep"), method("m/a.(B).Lost"), iface("m/a.S", True)]
    new = [iface("m/a.I", True, ["Keep()", "m/a.seal()", "New()"]), method("m/a.(I).seal"), iface("m/a.J", True, ["Keep()", "New()"]), iface("m/a.B", True, ["Keep()", "New()"]), method("m/a.(B).Keep"), method("m/a.(B).New"), {**iface("m/a.S"), "interface": False}]
    embeds = [("m/a.I", "m/a.J", "embeds"), ("m/a.J", "m/a.B", "embeds")]
    got, says = changes(spark, old, new, (embeds, embeds), **facts)
    through = {("m/a.I", "New", "gained", "embedded", "m/a.J", "m/a.B"), ("m/a.I", "Lost", "lost", "embedded", "m/a.J", "m/a.B"), ("m/a.J", "New", "gained", "embedded", "m/a.B", "m/a.B"), ("m/a.J", "Lost", "lost", "embedded", "m/a.B", "m/a.B")}
    # Own and B's Lost were declared: vertices that are gone tell of them
    assert got == through | {("m/a.I", "m/a.seal", "gained", "declared", None, None), ("m/a.B", "New", "gained", "declared", None, None)}
    assert "no interface any more: m/a.S" in says and "interface m/a.I: method New gained by embedding m/a.J" in says and "gone: m/a.(I).Own" in says
    types = {**facts, "level": "type"}
    assert ("m/a.I", "New", "gained", None, None, None) in changes(spark, old, new, (embeds, embeds), **types)[0]
