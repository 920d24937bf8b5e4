"""Calls of HTTP clients from fact rows: declared wrappers, client facts and their counts."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.functions.routes import METHODS
from edgewise.functions.urls import compose_url
from edgewise.graph import SYMBOL_KINDS

LANGUAGES = ("swift", "kotlin", "dart", "js", "go")
FIELDS = ("language", "kind", "owner", "name", "methodArg", "pathArg", "defaultMethod", "methodEnum", "pathAnchor", "service")
#: A file of declarations is driver data and is broadcast, so its size is bounded.
MAX_BYTES = 16 << 20


def _argument(ref: object) -> str:
    if not isinstance(ref, dict) or set(ref) - {"index", "label"}:
        return "not an index or label"
    index, label = ref.get("index"), ref.get("label") or ""
    if index is not None and (isinstance(index, bool) or not isinstance(index, int)):
        return "index"
    if not isinstance(label, str):
        return "label"
    return "" if label or (index is not None and index >= 0) else "neither index nor label"


def wrapper_problem(w: object) -> str:
    """Why a declaration cannot be used; empty if it can."""
    if not isinstance(w, dict):
        return "not an object"
    if set(w) - set(FIELDS):
        return f"unknown field {min(set(w) - set(FIELDS))}"
    if w.get("language") not in LANGUAGES:
        return "language"
    if w.get("kind") not in ("constructor", "function"):
        return "kind"
    for f in ("owner", "name"):
        if not isinstance(w.get(f), str) or not w[f].strip():
            return f
    if problem := _argument(w.get("pathArg")):
        return f"pathArg: {problem}"
    if w.get("methodArg") is not None and (problem := _argument(w["methodArg"])):
        return f"methodArg: {problem}"
    default = w.get("defaultMethod") or ""
    if default not in ("", *METHODS) or (not default and w.get("methodArg") is None):
        return "defaultMethod"
    if w.get("pathAnchor") not in ("root", "base"):
        return "pathAnchor"
    enum = w.get("methodEnum") or {}
    if not isinstance(enum, dict) or not all(v in METHODS for v in enum.values()):
        return "methodEnum"
    return "" if isinstance(w.get("service") or "", str) else "service"


def load_wrappers(text: str) -> list[dict]:
    """Declarations of one JSON document; ValueError for what is wrong, unknown fields too."""
    if len(text.encode()) > MAX_BYTES:
        raise ValueError(f"wrappers: over {MAX_BYTES} bytes")
    doc = json.loads(text)
    if not isinstance(doc, dict) or doc.get("format") != "http-wrappers" or doc.get("version") != 1 or set(doc) - {"format", "version", "wrappers"}:
        raise ValueError("wrappers: no http-wrappers document of version 1")
    if not isinstance(doc.get("wrappers"), list):
        raise ValueError("wrappers: no list")
    for k, w in enumerate(doc["wrappers"]):
        if problem := wrapper_problem(w):
            raise ValueError(f"wrappers[{k}]: {problem}")
    return doc["wrappers"]


def bind(ref: dict | None, arguments: list[dict]) -> dict | None:
    """The argument a reference means: that of its label, or else that at its index, unless
    the one there carries another label."""
    if ref is None:
        return None
    label, index = ref.get("label") or "", ref.get("index")
    if label:
        for a in arguments:
            if a.get("label") == label:
                return a
    if index is None or not 0 <= index < len(arguments):
        return None
    a = arguments[index]
    return None if label and a.get("label") and a["label"] != label else a


def wrapper_method(w: dict, arguments: list[dict]) -> str:
    """Method of a call; empty if it has one that is not known."""
    a = bind(w.get("methodArg"), arguments)
    if a is None:
        return w.get("defaultMethod") or ""
    case, literal = a.get("enumCase") or "", a.get("literal")
    return (w.get("methodEnum") or {}).get(case, "") or (literal if literal in METHODS else "")


_CALL = pa.schema([("wrapper", pa.int32()), ("bound", pa.bool_()), ("method", pa.string()), ("dynamic", pa.bool_()), ("channel", pa.string()), ("prefix", pa.string()), ("anchor", pa.string()), ("authority", pa.string()), ("query", pa.bool_()), ("ambiguous", pa.bool_()), ("service", pa.string())])


def _call(k: int, w: dict, arguments: list[dict]) -> dict:
    path = bind(w["pathArg"], arguments)
    if path is None:
        return {"wrapper": k, "bound": False}
    parts = [("lit", p["text"] or "") if p["kind"] == "lit" else (p["kind"],) for p in path.get("parts") or []]
    url = compose_url(parts, relative_base=w["pathAnchor"] == "base")
    if w["pathAnchor"] == "base" and not parts:
        url["anchor"] = "base"
    return {"wrapper": k, "bound": True, "method": wrapper_method(w, arguments), "dynamic": bool(url.get("dynamic")), "channel": url.get("template"), "prefix": url.get("prefix"), "anchor": url["anchor"], "authority": url.get("authority"), "query": url["query"], "ambiguous": bool(url.get("ambiguous")), "service": w.get("service")}


def wrapper_calls(calls: DataFrame, wrappers: list[dict], language: str = "go") -> DataFrame:
    """Client calls that go through declared wrappers; one narrow pass after a broadcast.

    ``calls``: owner (caller), callee_owner, callee_name, arguments (array of label,
    enumCase, literal and parts of kind and text), path, line, column. Calls of which the
    path cannot be bound stay, with ``bound`` false.
    """
    spark: SparkSession = calls.sparkSession
    mine = [(k, w["owner"], w["name"]) for k, w in enumerate(wrappers) if w["language"] == language]
    keys = spark.createDataFrame(mine, "_k int, callee_owner string, callee_name string")
    rows = calls.join(F.broadcast(keys), ["callee_owner", "callee_name"])
    kept = ["owner", "path", "line", "column"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for batch in batches:
            found = [_call(r["_k"], wrappers[r["_k"]], r["arguments"] or []) for r in batch.select(["_k", "arguments"]).to_pylist()]
            new = pa.RecordBatch.from_pylist(found, schema=_CALL)
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *new.columns], [*kept, *_CALL.names])

    names = {pa.string(): "string", pa.bool_(): "boolean", pa.int32(): "int"}
    schema = ", ".join([*(f"{n} {types[n]}" for n in kept), *(f"{f.name} {names[f.type]}" for f in _CALL)])
    return rows.select(*kept, "_k", "arguments").mapInArrow(run, schema)


def wrapper_gaps(calls: DataFrame, wrappers: list[dict], declared: DataFrame, language: str = "go") -> DataFrame:
    """(wrapper, gap) of declarations without a declaration in ``declared`` (owner, name),
    without a call, or with calls whose path cannot be bound."""
    mine = [(k, w["owner"], w["name"]) for k, w in enumerate(wrappers) if w["language"] == language]
    keys = calls.sparkSession.createDataFrame(mine, "wrapper int, owner string, name string")
    known = declared.select("owner", "name", F.lit(True).alias("_known")).distinct()
    met = calls.groupBy("wrapper").agg(F.count("*").alias("n"), F.count_if(~F.col("bound")).alias("unbound"))
    gap = F.when(F.col("_known").isNull(), "no-declaration").when(F.col("n").isNull(), "no-call").when(F.col("unbound") > 0, "path-not-bound")
    return keys.join(known, ["owner", "name"], "left").join(met, "wrapper", "left").select("wrapper", gap.alias("gap")).where("gap is not null")


_FACT = ["method", "dynamic", "channel", "prefix", "anchor", "authority", "query", "service", "path", "line", "column", "symbol"]


def client_facts(calls: DataFrame, wrapped: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, counts) of ``calls``: the columns of a fact and owner, ambiguous, unresolved,
    parameter and from_wrapper.

    A direct call inside a wrapper (``wrapped``: owner) that leaves path or method open is
    what the wrapper's callers state, and goes. Equal facts stay once. Counts: facts
    without a symbol of the graph, with an unresolved base, with an ambiguous join, and
    functions that pass a parameter on without a declaration.
    """
    loose = F.col("dynamic") | (F.coalesce("method", F.lit("")) == "")
    direct = ~F.col("from_wrapper")
    inside = wrapped.select("owner", F.lit(True).alias("_inside")).distinct()
    rows = calls.where("path is not null").join(inside, "owner", "left")
    rows = rows.where(~(direct & loose & F.col("_inside").isNotNull()))
    symbols = vertices.where(F.col("kind").isin(SYMBOL_KINDS)).select(F.col("id").alias("symbol")).distinct()
    rows = rows.join(symbols, F.col("owner") == F.col("symbol"), "left")
    passes = F.max(F.when(loose & direct & F.col("parameter"), F.col("owner"))).alias("_passes")
    facts = rows.groupBy(*_FACT).agg(F.max("ambiguous").alias("_ambiguous"), F.max("unresolved").alias("_unresolved"), passes)
    counts = facts.agg(
        F.count_if(F.col("symbol").isNull()).alias("missing_symbols"),
        F.count_if(F.col("_unresolved") & ~F.col("dynamic")).alias("unresolved_bases"),
        F.count_if("_ambiguous").alias("ambiguous_joins"),
        F.countDistinct("_passes").alias("undeclared_wrappers"),
    )
    return facts.select(*_FACT), counts


def ordered_calls(facts: DataFrame) -> DataFrame:
    return facts.orderBy("path", "line", "column", "method", "channel", "prefix", "anchor")
