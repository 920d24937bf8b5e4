"""Snapshot diff with breaking changes, and baselines as multisets of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgewise.functions.ids import canonical_id, member_owner
from edgewise.graph import Graph, symbols
from edgewise.operators.fixpoints import fixpoint
from edgewise.operators.reach import bucketed
from edgewise.session import stage


def category() -> Column:
    return F.when(F.col("kind").isin("package", "module"), F.lit("pkg")).otherwise("sym")


def indexed(g: Graph) -> DataFrame:
    """Vertices with their matching key, category and canonical id."""
    return g.vertices.withColumn("key", F.concat(category(), F.lit("\0"), canonical_id(F.col("id")))).dropDuplicates(["key"])


def matched(old: Graph, new: Graph) -> DataFrame:
    """Full outer match of both vertex sets: key, o, n (structs, null where absent)."""
    a, b = (indexed(g).select("key", F.struct(*g.vertices.columns).alias(n)) for g, n in ((old, "o"), (new, "n")))
    return a.join(b, "key", "full_outer")


def vertex_diff(old: Graph, new: Graph) -> DataFrame:
    """(id, change): added and removed vertices."""
    m = matched(old, new).where("o is null or n is null")
    return m.select(F.coalesce("o.id", "n.id").alias("id"), F.when(F.col("o").isNull(), "added").otherwise("removed").alias("change"))


def attribute_changes(old: Graph, new: Graph) -> DataFrame:
    """(id, field, from, to) of changed kind, exported, generated, external and constant value."""
    m = matched(old, new).where("o is not null and n is not null")
    text = lambda c: c.cast("string")
    cases = [F.when(F.col(f"o.{f}") != F.col(f"n.{f}"), F.struct(F.lit(f).alias("field"), text(F.col(f"o.{f}")).alias("from"), text(F.col(f"n.{f}")).alias("to"))) for f in ("kind", "exported", "generated", "external")]
    value = (F.col("o.kind") == "const") & (F.col("o.value") != "") & (F.col("n.value") != "") & (F.col("o.value") != F.col("n.value"))
    cases.append(F.when(value, F.struct(F.lit("value").alias("field"), F.col("o.value").alias("from"), F.col("n.value").alias("to"))))
    return m.select(F.col("n.id").alias("id"), F.explode(F.array_compact(F.array(*cases))).alias("c")).select("id", "c.*")


def _name(f: Column) -> Column:
    return F.substring_index(f, ":", 1)


def field_changes(old: Graph, new: Graph) -> DataFrame:
    """(id, added, removed, retyped, reordered) of types with field lists on both sides."""
    m = matched(old, new).where("o.fields is not null and n.fields is not null")
    names = lambda c: F.transform(c, _name)
    m = m.withColumns({"of": names(F.col("o.fields")), "nf": names(F.col("n.fields"))})
    kept_old, kept_new = F.filter("of", lambda x: F.array_contains("nf", x)), F.filter("nf", lambda x: F.array_contains("of", x))
    retyped = F.filter("o.fields", lambda f: F.array_contains("nf", _name(f)) & ~F.array_contains("n.fields", f))
    out = m.select(
        F.col("n.id").alias("id"), F.array_sort(F.array_except("nf", "of")).alias("added"), F.array_sort(F.array_except("of", "nf")).alias("removed"),
        F.array_sort(F.array_distinct(names(retyped))).alias("retyped"), (kept_old != kept_new).alias("reordered"),
    )
    return out.where("size(added) + size(removed) + size(retyped) > 0 or reordered")


def signatures(g: Graph) -> DataFrame:
    """(key, target, actual): signature targets of exported symbols, canonical and as spelt."""
    owners = symbols(g).where("exported").select("id").distinct()
    e = g.edges.where("kind = 'signature'").join(owners.withColumnRenamed("id", "src"), "src", "left_semi")
    return e.groupBy(canonical_id(F.col("src")).alias("key"), canonical_id(F.col("dst")).alias("target")).agg(F.max("dst").alias("actual"), F.max("src").alias("id"))


def signature_diff(old: Graph, new: Graph) -> DataFrame:
    """(id, added, removed) for symbols of both snapshots whose signature targets differ."""
    both = matched(old, new).where("o is not null and n is not null and o.exported").select(canonical_id(F.col("n.id")).alias("key"), F.col("n.id").alias("nid")).distinct()
    a, b = signatures(old), signatures(new)
    gone = a.join(b.select("key", "target"), ["key", "target"], "left_anti").select("key", "actual", F.lit("removed").alias("c"))
    come = b.join(a.select("key", "target"), ["key", "target"], "left_anti").select("key", "actual", F.lit("added").alias("c"))
    rows = gone.union(come).join(both, "key")
    of = lambda c: F.array_sort(F.collect_list(F.when(F.col("c") == c, F.col("actual")))).alias(c)
    return rows.groupBy(F.col("nid").alias("id")).agg(of("added"), of("removed"))


def edge_diff(old: Graph, new: Graph) -> DataFrame:
    """(src, dst, kind, change): relations, ownership included, that only one snapshot has, by canonical ids."""
    key = lambda g: g.edges.select(canonical_id(F.col("src")).alias("src"), canonical_id(F.col("dst")).alias("dst"), "kind").distinct()
    a, b = key(old), key(new)
    on = ["src", "dst", "kind"]
    return b.join(a, on, "left_anti").withColumn("change", F.lit("added")).union(a.join(b, on, "left_anti").withColumn("change", F.lit("removed")))


def _methods(g: Graph) -> DataFrame:
    """(key, id, method, signature) of the method sets of interfaces; a method reads ``Name`` and its signature."""
    i = indexed(g).where("interface").select("key", "id", F.explode_outer("methods").alias("m"))
    return i.select("key", "id", F.regexp_extract("m", r"^([^(: ]*)", 1).alias("method"), F.regexp_replace("m", r"^[^(: ]*[: ]?", "").alias("signature")).where("method <> ''")


def _declared(g: Graph) -> DataFrame:
    """(owner, method): methods with a vertex of their own, by the canonical id of the type they belong to."""
    id = canonical_id(F.col("id"))
    v = g.vertices.where("kind = 'method'").select(member_owner(id).alias("owner"), F.regexp_extract(id, r"\)\.([^.]*)$", 1).alias("method"))
    return v.where("owner is not null").distinct()


def embedding_interfaces(g: Graph) -> DataFrame:
    """(outer, inner, depth): which interfaces hold which ones by embedding, at their least depth; each holds itself at 0. Ids are
    canonical, and what is embedded need not be in the document."""
    i = indexed(g).where("interface").select(canonical_id(F.col("id")).alias("id")).distinct()
    e = g.edges.where("kind = 'embeds'").select(canonical_id(F.col("src")).alias("inner"), canonical_id(F.col("dst")).alias("next")).distinct()
    e = bucketed(e.join(i.withColumnRenamed("id", "inner"), "inner", "left_semi"), "interface_embeds", "inner")
    first = i.select(F.col("id").alias("outer"), F.col("id").alias("inner"), F.lit(0).alias("depth"))
    derive = lambda new, known: e.join(new, "inner").select("outer", F.col("next").alias("inner"), (F.col("depth") + 1).alias("depth")).dropDuplicates(["outer", "inner"])
    return stage(fixpoint(first, ["outer", "inner"], derive, "interfaces").select("outer", "inner", "depth"), "interfaces")


def method_sources(g: Graph) -> DataFrame:
    """(owner, method, declared, via, origin) of all methods in the sets of interfaces.

    ``via`` is the first directly embedded interface whose set has the method, ``origin`` the nearest
    one that declares it; both are null for declared methods and for what comes from
    outside the document, or if the document has no methods of its own.
    """
    sets = _methods(g).select(canonical_id(F.col("id")).alias("owner"), "method").distinct()
    package = g.vertices.where("interface").select(canonical_id(F.col("id")).alias("owner"), F.col("package").alias("_p")).dropDuplicates(["owner"])
    own = F.col("method").startswith(F.concat("_p", F.lit(".")))
    short = F.when(own, F.substring("method", F.length("_p") + 2, F.length("method"))).otherwise(F.col("method"))
    sets = stage(sets.join(package, "owner", "left").select("owner", "method", F.coalesce(short, "method").alias("short")), "method-sets")
    inner = embedding_interfaces(g)
    says = _declared(g).select(F.col("owner").alias("inner"), F.col("method").alias("short"))
    declared = sets.join(says.withColumnRenamed("inner", "owner"), ["owner", "short"], "left_semi").select("owner", "method", F.lit(True).alias("declared"))
    held = sets.join(inner.where("depth > 0").withColumnRenamed("outer", "owner"), "owner")
    origin = held.join(says, ["inner", "short"]).groupBy("owner", "method").agg(F.min(F.struct("depth", "inner")).alias("o"))
    via = held.where("depth = 1").join(sets.select(F.col("owner").alias("inner"), "method"), ["inner", "method"]).groupBy("owner", "method").agg(F.min("inner").alias("via"))
    on = ["owner", "method"]
    out = sets.join(declared, on, "left").join(via, on, "left").join(origin, on, "left")
    only = lambda c: F.when(F.col("declared").isNull() & F.lit(g.meta.level == "symbol"), c)
    return out.select("owner", "method", F.coalesce("declared", F.lit(False)).alias("declared"), only(F.col("via")).alias("via"), only(F.col("o.inner")).alias("origin"))


def interface_changes(old: Graph, new: Graph) -> DataFrame:
    """(id, method, change, how, via, origin): what changes for those who implement or use exported interfaces of both snapshots.

    With method sets on both sides: methods gained, changed, or lost by embedding (a lost declared one is a vertex
    that is gone); ``how`` is declared or embedded, unknown where a document has no method vertices.
    Without them: methods that have a vertex now, for their interface and all that embed it at any depth, and
    interfaces that are embedded now (no method; the change is ``embeds``).
    """
    both = matched(old, new).where("o.interface and o.exported and n.interface").select("key", canonical_id(F.col("n.id")).alias("owner"), F.col("n.id").alias("id"))
    if not (old.meta.interfaceMethodSets and new.meta.interfaceMethodSets):
        return _vertex_gains(old, new)
    a, b = (_methods(g).select("key", "method", F.col("signature").alias(n)) for g, n in ((old, "a"), (new, "b")))
    m = a.join(b, ["key", "method"], "full_outer").join(both, "key").where(~F.col("a").eqNullSafe(F.col("b")))
    m = m.withColumn("change", F.when(F.col("a").isNull(), "gained").when(F.col("b").isNull(), "lost").otherwise("changed"))
    source = method_sources(new).withColumn("lost", F.lit(False)).union(method_sources(old).withColumn("lost", F.lit(True)))
    m = m.withColumn("lost", F.col("change") == "lost").join(source, ["owner", "method", "lost"], "left").where("NOT (lost AND declared)")
    known = F.lit(new.meta.level == "symbol") | F.col("lost")
    return m.select("id", "method", "change", F.when(known, F.when(F.col("declared"), "declared").otherwise("embedded")).alias("how"), "via", "origin")


def _vertex_gains(old: Graph, new: Graph) -> DataFrame:
    met = matched(old, new)
    visible = met.where("o is not null and n.exported").select(canonical_id(F.col("n.id")).alias("outer"), F.col("n.id").alias("id"))
    fresh = met.where("o is null and n.kind = 'method'").select(canonical_id(F.col("n.id")).alias("_id"))
    fresh = fresh.select(member_owner(F.col("_id")).alias("inner"), F.regexp_extract("_id", r"\)\.([^.]*)$", 1).alias("method")).where("inner is not null")
    inner = embedding_interfaces(new)
    own = inner.where("depth = 0").select("inner")
    gained = fresh.join(own, "inner", "left_semi").join(inner, "inner").join(visible, "outer")
    far = lambda c: F.when(F.col("depth") > 0, c)
    gained = gained.select("id", "method", F.lit("gained").alias("change"), F.when(F.col("depth") > 0, "embedded").otherwise("declared").alias("how"), far(F.col("inner")).alias("via"), far(F.col("inner")).alias("origin"))
    key = lambda g: g.edges.where("kind = 'embeds'").select(canonical_id(F.col("src")).alias("outer"), canonical_id(F.col("dst")).alias("inner")).distinct()
    more = key(new).join(key(old), ["outer", "inner"], "left_anti").join(own, "inner", "left_semi").join(own.withColumnRenamed("inner", "outer"), "outer", "left_semi").join(visible, "outer")
    return gained.union(more.select("id", F.lit(None).cast("string"), F.lit("embeds"), F.lit("embedded"), F.col("inner"), F.col("inner"))).distinct()


def type_set_changes(old: Graph, new: Graph) -> DataFrame:
    """(id, from, to) of exported constraints whose type sets differ; only where both documents carry them."""
    m = matched(old, new).where("o.interface and n.interface and n.exported").where(~F.col("o.typeSet").eqNullSafe(F.col("n.typeSet")))
    show = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))), "; "), F.lit("any type"))
    return m.where(F.lit(old.meta.interfaceTypeSets and new.meta.interfaceTypeSets)).select(F.col("n.id").alias("id"), show(F.col("o.typeSet")).alias("from"), show(F.col("n.typeSet")).alias("to"))


def breaking(old: Graph, new: Graph) -> DataFrame:
    """(phase, key, seq, message), to be sorted by the first three: changes that break users."""
    m = matched(old, new)
    owner = F.concat(F.lit("sym\0"), member_owner(F.col("o.id")))
    held = _methods(new).select(F.col("key").alias("_k"), F.col("method").alias("_m")).distinct()
    gone = m.where("n is null and o.exported").withColumn("_owner", owner)
    gone = gone.join(held, (F.col("_owner") == F.col("_k")) & (F.col("o.name") == F.col("_m")) & (F.col("o.kind") == "method") & F.lit(old.meta.interfaceMethodSets), "left_anti")
    row = lambda df, phase, seq, text, key="key": df.select(F.lit(phase).alias("phase"), F.col(key).alias("key"), F.lit(seq).alias("seq"), text.alias("message"))
    both = m.where("o is not null and n is not null and o.exported")
    id, say = F.col("n.id"), lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in x))
    parts = [
        row(gone, 0, 0, say("gone: ", F.col("o.id"))),
        row(both.where("o.kind <> n.kind"), 0, 1, say("kind of ", id, ": was ", F.col("o.kind"), ", is ", F.col("n.kind"))),
        row(both.where("not n.exported"), 0, 2, say("no more visible: ", id)),
        row(both.where("o.kind = 'const' and o.value <> '' and n.value <> '' and o.value <> n.value"), 0, 3, say("value of constant ", id, ": was ", F.col("o.value"), ", is ", F.col("n.value"))),
        row(both.where("o.fields is not null and n.fields is null"), 0, 4, say("no struct any more: ", id)),
    ]
    fields = field_changes(old, new).join(both.select(id.alias("id"), "key", "o.fields", F.col("n.fields").alias("nf")), "id")
    upper = lambda c: c.rlike(r"^\p{Lu}")
    type_of = lambda fields, f: F.element_at(F.transform(F.filter(fields, lambda x: _name(x) == f), lambda x: F.substring(x, F.length(f) + 2, F.lit(1 << 30))), 1)
    removed = fields.select("key", "id", F.explode("removed").alias("f")).where(upper(F.col("f")))
    parts.append(row(removed, 0, 5, say("field gone: ", F.col("id"), ".", F.col("f"))))
    retyped = fields.select("key", "id", "fields", "nf", F.explode("retyped").alias("f"))
    retyped = retyped.select("key", "id", "f", type_of(F.col("fields"), F.col("f")).alias("a"), type_of(F.col("nf"), F.col("f")).alias("b"))
    parts.append(row(retyped.where(upper(F.col("f"))), 0, 6, say("type of field ", F.col("id"), ".", F.col("f"), ": was ", F.col("a"), ", is ", F.col("b"))))
    embeds = reduce(DataFrame.union, [g.edges.where("kind = 'embeds'").select(canonical_id(F.col("src")).alias("_s"), canonical_id(F.col("dst")).alias("_t")) for g in (old, new)]).distinct()
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\*", ""), r"\[.*$", "")
    inner = retyped.where(~upper(F.col("f"))).join(embeds, (canonical_id(F.col("id")) == F.col("_s")) & F.col("_t").isin(bare(F.col("a")), bare(F.col("b"))) & (F.substring_index("_t", ".", -1) == F.col("f")), "left_semi")
    parts.append(row(inner, 0, 7, say("type of embedded field ", F.col("id"), ".", F.col("f"), ": was ", F.col("a"), ", is ", F.col("b"), "; what it promotes may differ")))
    literal = fields.where(F.forall("fields", lambda f: upper(_name(f))) & ((F.size("added") > 0) | F.col("reordered")))
    parts.append(row(literal, 0, 8, say("fields of ", F.col("id"), " came in or moved: literals without field names break")))
    lost = signature_diff(old, new).where("size(removed) > 0").select("id", F.explode("removed").alias("t")).join(both.select(id.alias("id"), "key"), "id")
    parts.append(row(lost, 0, 9, say("signature of ", F.col("id"), " lost ", F.col("t"))))
    if old.meta.interfaceMethodSets and new.meta.interfaceMethodSets:
        stops = m.where("o.interface and o.exported and n is not null and not n.interface")
        parts.append(row(stops, 1, 0, say("no interface any more: ", id)))
    changes = stage(interface_changes(old, new), "interface-changes")
    by = F.when(F.col("how") == "embedded", F.concat(F.lit(" by embedding"), F.coalesce(F.concat(F.lit(" "), "via"), F.lit("")))).otherwise("")
    parts.append(row(changes.where("method is not null"), 1, 1, say("interface ", F.col("id"), ": method ", F.col("method"), " ", F.col("change"), F.when(F.col("change") == "changed", "").otherwise(by)), "id"))
    parts.append(row(changes.where("method is null"), 1, 2, say("interface ", F.col("id"), " embeds ", F.col("via"), " now"), "id"))
    types = type_set_changes(old, new)
    parts.append(row(types, 2, 0, say("type set of ", F.col("id"), ": was ", F.col("from"), ", is ", F.col("to")), "id"))
    return reduce(DataFrame.union, parts)


def notes(old: Graph, new: Graph) -> list[str]:
    out = []
    if old.meta.level != new.meta.level:
        out.append(f"levels differ ({old.meta.level}, {new.meta.level}): their vertices cannot be compared")
    if old.meta.module != new.meta.module:
        out.append(f"modules differ ({old.meta.module}, {new.meta.module})")
    if old.meta.interfaceTypeSets != new.meta.interfaceTypeSets:
        out.append("type sets were not compared: one document has none")
    return sorted(out)


def split_baseline(items: DataFrame, baseline: DataFrame) -> DataFrame:
    """``items`` (key, ord, ...) with ``state`` fresh or baselined, and ``baseline`` (key, ord, ...) entries left over as stale.

    A multiset match: of each key the first as many items as there are entries are
    baselined, and as many entries as are left over, the first ones, are stale.
    """
    rn = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    n_base = baseline.groupBy("key").agg(F.count("*").alias("_n"))
    n_items = items.groupBy("key").agg(F.count("*").alias("_n"))
    a = items.withColumn("_r", rn).join(n_base, "key", "left").withColumn("state", F.when(F.col("_r") <= F.coalesce("_n", F.lit(0)), "baselined").otherwise("fresh"))
    b = baseline.withColumn("_r", rn).join(n_items, "key", "left")
    b = b.withColumn("_all", F.count("*").over(Window.partitionBy("key"))).where("_r <= _all - coalesce(_n, 0)").withColumn("state", F.lit("stale"))
    return a.select("key", "ord", "state").union(b.select("key", "ord", "state"))


def violation_key(v: str = "") -> Column:
    """Key of a violation by the family of its rule."""
    c = lambda n: F.coalesce(F.col(f"{v}{n}"), F.lit(""))
    join = lambda *x: F.concat_ws("\0", *x)
    base = F.substring_index(F.coalesce(F.col(f"{v}position.file"), F.lit("")), "/", -1)
    return (
        F.when(c("rule").isin("forbidden", "independence"), join(c("rule"), c("fromComponent"), c("toComponent")))
        .when(c("rule") == "fileScope", join(c("rule"), c("name"), c("from"), c("to"), base))
        .when(c("rule") == "limit", join(c("rule"), c("name"), c("fromComponent"), c("toComponent")))
        .otherwise(join(c("rule"), c("kind"), canonical_id(c("from")), canonical_id(c("to")), c("fromComponent"), c("toComponent")))
    )


def cycle_keys(members: DataFrame) -> DataFrame:
    """(component, key): the canonical members of each cycle, sorted."""
    return members.groupBy("component").agg(F.array_join(F.array_sort(F.collect_list(canonical_id(F.col("id")))), "\0").alias("key"))


def finding_key() -> Column:
    return F.concat_ws("\0", F.col("kind"), canonical_id(F.col("id")))
