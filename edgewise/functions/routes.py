"""Routes from fact rows: prefix chains of routers, declared routes, gaps and their scopes.

Three tables describe a program's routers. ``routers`` (router, derived, slash): a derived
router hangs below another one that may be unknown; slash is the closing-slash policy set
on a gin engine. ``parents`` (child, at, parent, kind, prefix, dynamic): where a router is
mounted, in order; kind is chi, gin, echo, host or strip, and a null parent is a mount
outside of what was read. ``registrations`` (id, router, framework, pattern, methods,
mount, handler, anonymous, path, line, column): a null pattern or null methods are not
constant.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions import templates
from edgewise.graph import SYMBOL_KINDS
from edgewise.session import release, stage

METHODS = ("GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "TRACE")
#: Chains of one router that are followed; the rest is a gap.
MAX_CHAINS = 64
MAX_SCOPES, MAX_ELEMENTS, MAX_GROUP = 1000, 10_000, 256
PATH_FIELDS = ("templates", "templatePrefixes", "templateSuffixes")


class Routes(NamedTuple):
    facts: DataFrame
    gaps: DataFrame


def chains(routers: DataFrame, parents: DataFrame) -> DataFrame:
    """(router, top, steps, more): each way up from a router, innermost step first.

    One join a level. Ways are ordered by the places of the mounts taken, mounts outside
    first, the last of them foremost; ``more`` marks routers with over ``MAX_CHAINS`` ways.
    A level keeps one way beyond the limit for each router: each has at least one end, so
    no way within the limit is lost. A way that only leads back into itself ends there.
    """
    step = F.struct("kind", "prefix", F.coalesce("dynamic", F.lit(False)).alias("dynamic"))
    place = F.when(F.col("parent").isNull(), -1 - F.col("at")).otherwise(F.col("at"))
    up = parents.select(F.col("child").alias("node"), "parent", place.cast("int").alias("place"), step.alias("step"))
    kind = "array<struct<kind:string,prefix:string,dynamic:boolean>>"
    front = routers.select("router", F.col("router").alias("node"), F.array("router").alias("seen"), F.array().cast(kind).alias("steps"), F.array().cast("array<int>").alias("order"))
    front, done = stage(front.distinct(), "ways"), None
    ranked = Window.partitionBy("router").orderBy("order")
    columns = ["router", "top", "steps", "order"]
    while not front.isEmpty():
        open_ways = F.col("parent").isNull() | ~F.array_contains("seen", F.col("parent"))
        met = front.join(up, "node").where(open_ways)
        met = met.select("router", "node", "parent", "seen", F.concat("steps", F.array("step")).alias("steps"), "order", F.concat("order", F.array("place")).alias("next"))
        stuck = front.join(met.select("router", "order").distinct(), ["router", "order"], "left_anti")
        ends = stuck.select("router", F.col("node").alias("top"), "steps", "order")
        ends = ends.union(met.where("parent is null").select("router", F.lit(None).cast("string"), "steps", "next"))
        ends = stage(ends.toDF(*columns), "way-ends")
        after = met.where("parent is not null").select("router", F.col("parent").alias("node"), F.concat("seen", F.array("parent")).alias("seen"), "steps", F.col("next").alias("order"))
        after = after.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= MAX_CHAINS + 1).drop("_n")
        after = stage(after, "ways")
        done = ends if done is None else done.union(ends)
        release(front)
        front = after
    if done is None:
        done = front.select("router", F.col("node").alias("top"), "steps", "order")
    n = F.row_number().over(ranked)
    out = done.select(*columns, n.alias("n"), (F.count("*").over(Window.partitionBy("router")) > MAX_CHAINS).alias("more"))
    return out.where(F.col("n") <= MAX_CHAINS).select("router", "top", "steps", "more")


def below_mount(prefix: str, pattern: str) -> list[tuple[str, bool]]:
    """Patterns of a chi mount, and whether one stands for all below itself."""
    if not prefix:
        return [(pattern, False)]
    if prefix.endswith("/"):
        return [(prefix + pattern.removeprefix("/"), False)]
    own = {"/": [(prefix, False)], "/*": [(prefix, True)]}
    return [(prefix + pattern, False), *own.get(pattern, [])]


class Composed(NamedTuple):
    anchor: str
    host: str
    strips: list[str]
    patterns: list[tuple[str, bool]]


def compose(framework: str, pattern: str, steps: list[dict], rooted: bool, mount: bool = False) -> Composed:
    """A pattern under a chain of steps. A prefix that is not constant, or one outside of a
    stripped prefix, ends the chain: what is known is then anchored at an unknown base."""
    found = below_mount(pattern, "/*") if mount else [(pattern, False)]
    anchor, host, strips, groups = "root" if rooted else "base", "", [], []
    for s in steps:
        if s["dynamic"] or (strips and s["kind"] != "strip"):
            anchor = "base"
            break
        prefix = s["prefix"] or ""
        if s["kind"] == "strip":
            strips.append(prefix)
        elif s["kind"] == "chi":
            found = [(p, cap or before) for x, before in found for p, cap in below_mount(prefix, x)]
        elif s["kind"] == "host":
            host = prefix
        elif s["kind"] == framework:
            groups.append(prefix)
    if framework == "gin":
        base = "/"
        for g in reversed(groups):
            base = templates.join_gin(base, g)
        found = [(templates.join_gin(base, p), cap) for p, cap in found]
    elif framework == "echo":
        whole = "".join(reversed(groups))
        found = [("/" + (whole + p).removeprefix("/"), cap) for p, cap in found]
    return Composed(anchor, host, strips, found)


def _leaf(segments: list[tuple]) -> str:
    show = {"lit": lambda s: s[1], "param": lambda s: ":", "part": lambda s: s[1] + ":", "all": lambda s: "*"}
    return "".join("/" + show[s[0]](s) for s in segments)


def _parsed(framework: str, pattern: str):
    """(segments, capped, method, host); None if it cannot be registered, "dynamic" if it is no template."""
    if framework == "servemux":
        got = templates.parse_servemux(pattern)
        return got and (got[2], False, got[0] or "ANY", got[1])
    if framework == "chi":
        got = templates.parse_chi(pattern)
        return "dynamic" if got and got[2] else got and (got[0], got[1], None, "")
    if framework == "echo" and "*" in pattern[:-1]:
        return "dynamic"
    parse = templates.parse_gin if framework == "gin" else templates.parse_echo
    return parse(pattern), False, None, ""


def expand(r: dict, slash_middleware: frozenset[str] = frozenset()) -> list[dict]:
    """Rows of one registration under one chain: facts, or gaps (``gap`` set)."""
    if r["pattern"] is None:
        return [{"gap": "path-not-constant"}]
    fw, top = r["framework"], r["top"]
    rooted = top is not None and not r["derived"]
    c = compose(fw, r["pattern"], r["steps"] or [], rooted, bool(r["mount"]))
    out = [{"gap": "chains-beyond-limit"}] if r["more"] else []
    for pattern, below in c.patterns:
        parsed = _parsed(fw, pattern)
        if parsed is None:
            continue
        made = parsed != "dynamic" and templates.shapes(parsed[0], parsed[1])
        if not made:
            out.append({"gap": "not-canonical"})
            if parsed != "dynamic":
                out.append({"gap": "expansion-capped"})
            continue
        segments, _, method, host = parsed
        methods = [method] if method else r["methods"]
        host = host or c.host
        instance = f"{'node:' + top if top is not None else 'reg:' + str(r['id'])}|{host}"
        for template, note in made:
            bare = template
            for s in c.strips:
                template = "/" + "/".join(map(templates.encode_segment, s.removeprefix("/").split("/"))) + template
            variant = note == "variant"
            cap = note == "cap" or (below and not variant)
            row = {"instance": instance, "channel": template, "anchor": c.anchor, "variant": variant, "cap": cap, "narrowed": bool(host)}
            if methods is None:
                out.append({**row, "gap": "method-not-constant"})
                continue
            row["slash"] = templates.trailing_slash(fw, bare, rooted, r["slash"] or "optional", fw in slash_middleware)
            if fw == "echo":
                row["tokens"] = _leaf(segments)
                row["leaf"] = not variant and not cap and segments[-1][0] in ("param", "part")
                row["anchored"] = c.anchor == "root" and not c.strips
            kept = [m for m in dict.fromkeys(methods) if m == "ANY" or m in METHODS]
            out += [{**row, "method": m} for m in kept]
            if kept and c.anchor == "base":
                out.append({**row, "gap": "prefix-unresolved"})
    return out


_ROW = pa.schema([(n, pa.string()) for n in ("gap", "instance", "channel", "anchor", "method", "slash", "tokens")] + [(n, pa.bool_()) for n in ("variant", "cap", "narrowed", "leaf", "anchored")])
_KEPT = ["id", "framework", "handler", "anonymous", "path", "line", "column"]
_FACT = ["method", "channel", "anchor", "slash", "narrowed", "cap", "path", "line", "column", "symbol"]


def route_facts(registrations: DataFrame, routers: DataFrame, parents: DataFrame, vertices: DataFrame, slash_middleware: tuple[str, ...] = ()) -> Routes:
    """Declared routes, once each, and gaps (gap, id, channel, anchor, method, scope).

    An empty-value variant gives way to a route that the same router declares for that
    template and method (or ANY). An echo route that ends in a parameter takes longer
    paths too, unless the router has a route below it; every route names its proper
    prefixes for that test, so it is one equality join. ``symbol`` is the handler, if the
    graph holds it as a symbol; without one a route does not stand for all below itself.
    """
    ways = chains(routers, parents).join(routers.select(F.col("router").alias("top"), "derived", "slash"), "top", "left")
    rows = registrations.join(ways, "router", "left")
    names, middle = rows.columns, frozenset(slash_middleware)

    def run(batches):
        for batch in batches:
            found, at = [], []
            for k, row in enumerate(batch.to_pylist()):
                got = expand(row, middle)
                found += got
                at += [k] * len(got)
            kept = batch.select(_KEPT).take(pa.array(at, pa.int64()))
            new = pa.RecordBatch.from_pylist(found, schema=_ROW)
            yield pa.RecordBatch.from_arrays([*kept.columns, *new.columns], [*_KEPT, *_ROW.names])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{n} {types[n]}" for n in _KEPT), *(f"{f.name} {'string' if f.type == pa.string() else 'boolean'}" for f in _ROW)])
    rows = stage(rows.select(*names).mapInArrow(run, schema), "routes")
    made = rows.where("gap is null")
    explicit = made.where("not variant").select("instance", "channel", F.col("method").alias("by")).distinct()
    covers = made.select("instance", "channel", "method").where("method <> 'ANY'").distinct().join(explicit.where("by = 'ANY'").drop("by"), ["instance", "channel"], "left_semi")
    covers = explicit.withColumnRenamed("by", "method").union(covers.select("instance", "channel", "method")).distinct()
    kept = made.where("not variant").unionByName(made.where("variant").join(covers, ["instance", "channel", "method"], "left_anti"), allowMissingColumns=True)

    echo = made.where("framework = 'echo'")
    cut = F.expr("explode(transform(filter(sequence(1, length(tokens)), i -> i > 1 and substring(tokens, i, 1) = '/'), i -> substring(tokens, 1, i - 1)))")
    deeper = echo.select("instance", cut.alias("tokens")).distinct()
    leaves = echo.where("leaf").join(deeper, ["instance", "tokens"], "left_anti")
    ends = leaves.select("instance", "channel", F.lit(True).alias("_leaf")).distinct()
    unknown = rows.where("framework = 'echo' and gap = 'path-not-constant'").select("framework", F.lit(True).alias("_open")).distinct()
    symbols = vertices.where(F.col("kind").isin(SYMBOL_KINDS)).select(F.col("id").alias("symbol")).distinct()
    facts = kept.join(ends, ["instance", "channel"], "left").join(unknown, "framework", "left")
    facts = facts.withColumn("slash", F.when(F.col("_leaf") & F.col("_open"), None).when(F.col("_leaf"), "optional").otherwise(F.col("slash")))
    facts = facts.join(symbols, F.col("handler") == F.col("symbol"), "left").where("path is not null")
    facts = facts.withColumn("cap", F.col("cap") & F.col("symbol").isNotNull())
    gaps = rows.where("gap is not null").select("gap", "id", "channel", "anchor", "method", F.when(F.col("gap").isin("method-not-constant", "prefix-unresolved") & F.col("channel").isNotNull(), F.when(F.col("anchor") == "root", "templates").otherwise("templateSuffixes")).alias("scope"))
    longer = leaves.select(F.lit("echo-leaf").alias("gap"), "id", "channel", "anchor", "method", F.when(F.col("anchored"), "templatePrefixes").alias("scope"))
    return Routes(facts.select(*_FACT).dropDuplicates(), gaps.union(longer))


def ordered_routes(facts: DataFrame) -> DataFrame:
    """Facts by place, template, method and anchor."""
    return facts.orderBy("path", "line", "column", "channel", "method", "anchor")


def scope_prefix(template: str) -> str:
    """A template as a prefix: nothing from its catch-all on, no closing slash."""
    return template.split("{**}")[0].rstrip("/") or "/"


def scope_problem(scope: dict) -> str:
    """Why a scope of a gap cannot be used; empty if it can."""
    if set(scope) - {*PATH_FIELDS, "methods", "limitationIndex"}:
        return "unknown key"
    used = [f for f in PATH_FIELDS if f in scope]
    for f in used:
        if not isinstance(scope[f], list) or not scope[f]:
            return f"{f}: not a filled list"
        for x in scope[f]:
            if not isinstance(x, str) or templates.template_problem(x):
                return f"{f}: not a template"
            if f != "templates" and "{**}" in x:
                return f"{f}: catch-all"
            if f == "templatePrefixes" and x != "/" and x.endswith("/"):
                return f"{f}: closing slash"
            if f == "templateSuffixes" and x == "/":
                return f"{f}: bare slash"
    if not used:
        return "no templates, prefixes or suffixes"
    methods = scope.get("methods", ["GET"])
    if not isinstance(methods, list) or not methods:
        return "methods: not a filled list"
    if not all(isinstance(m, str) and m in METHODS for m in methods):
        return "methods: not a method"
    return "methods: repeated" if len(set(methods)) < len(methods) else ""


def limitations(gaps: DataFrame) -> tuple[list[dict], list[dict]]:
    """Counts of gaps by kind, and the scopes of those that have a usable one.

    A gap of which one row has no scope concerns the whole document. At most
    ``MAX_ELEMENTS`` elements come to the driver for a kind; a kind with more has none.
    """
    counted = gaps.groupBy("gap").agg(F.countDistinct("id").alias("n"), F.count_if(F.col("scope").isNull()).alias("bare")).orderBy("gap").collect()
    out, scopes, used = [], [], 0
    for at, row in enumerate(counted):
        out.append({"gap": row.gap, "count": row.n})
        if row.bare or len(scopes) >= MAX_SCOPES:
            continue
        mine = gaps.where(F.col("gap") == row.gap)
        found = mine.select("scope", "channel").distinct().limit(MAX_ELEMENTS + 1).collect()
        scope: dict = {}
        for f in PATH_FIELDS:
            some = {scope_prefix(x.channel) if f == "templatePrefixes" else x.channel for x in found if x.scope == f}
            if some:
                scope[f] = sorted(some)
        methods = sorted({x.method for x in mine.where("method is not null").select("method").distinct().collect()})
        if row.gap == "echo-leaf" and methods and "ANY" not in methods:
            scope["methods"] = methods
        size = sum(len(scope.get(f, [])) for f in PATH_FIELDS)
        if used + size <= MAX_ELEMENTS and not scope_problem(scope):
            scopes.append({"limitationIndex": at, **scope})
            used += size
    return out, scopes


def _order_problem(fact: dict, document: dict, places: dict, services: dict) -> str:
    if "order" not in fact:
        return ""
    order = fact["order"]
    if document.get("dispatch") != "registration-order":
        return "order without registration-order"
    if not isinstance(order, dict) or len(order) != 2:
        return "order: not group and index"
    group, index = order.get("group"), order.get("index")
    if not isinstance(group, str) or not group or group != group.strip() or re.search(r"[\x00-\x1f\x7f-\x9f]", group) or len(group.encode("utf-16-le")) > 2 * MAX_GROUP:
        return "order: group"
    if isinstance(index, bool) or not isinstance(index, (int, float)) or not 0 <= index <= 2**53 - 1 or index != int(index):
        return "order: index"
    at = fact.get("location") or {}
    place = tuple(at.get(k) for k in ("path", "line", "column"))
    if places.setdefault((group, int(index)), place) != place:
        return "order: one index for two places"
    service = fact.get("service") or document.get("service") or ""
    return "order: one group for several services" if services.setdefault(group, service) != service else ""


def document_problem(document: dict) -> str:
    """Why a document of route facts cannot be used, with the fact's number; empty if it can."""
    usr = lambda f: (f.get("symbol") or {}).get("usr") or ""
    key = lambda f, channel: (f.get("method"), usr(f), channel, f.get("service") or document.get("service") or "", str(sorted((f.get("order") or {}).items())))
    facts, places, services = document.get("facts") or [], {}, {}
    for k, f in enumerate(facts):
        if not isinstance(f, dict):
            return f"fact {k}: not an object"
        channel, dynamic = f.get("channel") or "", f.get("dynamic") is True
        if f.get("method") not in ("ANY", *METHODS):
            return f"fact {k}: method"
        if not dynamic and (problem := templates.template_problem(channel)):
            return f"fact {k}: template: {problem}"
        if f.get("catchAllPrefix") is True and (dynamic or "{**}" in channel or not usr(f)):
            return f"fact {k}: catch-all prefix"
        if problem := _order_problem(f, document, places, services):
            return f"fact {k}: {problem}"
    whole = {key(f, f.get("channel") or "") for f in facts if f.get("catchAllPrefix") is not True and f.get("dynamic") is not True}
    for k, f in enumerate(facts):
        if f.get("catchAllPrefix") is True and key(f, ("" if f["channel"] == "/" else f["channel"]) + "/{**}") not in whole:
            return f"fact {k}: catch-all prefix without its original"
    return ""
