"""URL expressions kept as rows, evaluated to parts level by level: texts, values, an origin, a query tail.

All expressions of a table are unfolded at once. Each level joins the nodes it reaches with their
rows, and numbers their operands in the order in which they are met; an expression unfolds MOST
nodes and a variable EACH times in it, what is beyond is a value. Then the levels fold up again, each by one ordered
aggregate. No task holds more than one expression's nodes of a level, so MOST rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgewise.operators.reach import bucketed
from edgewise.session import stage

MOST, EACH = 512, 4
PARTS = "array<struct<kind:string,text:string,ref:string>>"


def part(kind: str, text: Column | None = None, ref: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), (none if text is None else text).alias("text"), (none if ref is None else ref).alias("ref"))


def merged(parts: Column) -> Column:
    """Parts without empty texts, neighbouring texts as one."""

    def add(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(part("lit", F.concat(last["text"], p["text"]))))
        both = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["kind"] == "lit") & (p["kind"] == "lit")
        return F.when((p["kind"] == "lit") & (p["text"] == ""), done).when(both, joined).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(parts, F.array().cast(PARTS), add)


def _trimmed(parts: Column, every: Column) -> Column:
    """Parts without the slash at their end, or without all; a value there stays."""
    last = F.try_element_at(parts, F.lit(-1))
    text = F.when(every, F.regexp_replace(last["text"], "/+$", "")).otherwise(F.regexp_replace(last["text"], "/$", ""))
    cut = F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.when(text == "", F.array().cast(PARTS)).otherwise(F.array(part("lit", text))))
    return F.when(last["kind"] == "lit", cut).otherwise(parts)


def _folded(op: Column, kids: Column, text: Column, ref: Column) -> Column:
    """The parts of a node by those of its operands (ord, parts), in order. A URL has its host as operand 0 and its path as 1."""
    lists = F.transform(kids, lambda k: merged(k["parts"]))
    all_parts = merged(F.flatten(F.transform(kids, lambda k: k["parts"])))
    one = lambda n: F.flatten(F.transform(F.filter(kids, lambda k: k["ord"] == n), lambda k: merged(k["parts"])))
    host, path, has_host = one(0), one(1), F.exists(kids, lambda k: k["ord"] == 0)
    plain = (F.size(host) == 1) & (F.try_element_at(host, F.lit(1))["kind"] == "lit") & (F.coalesce(text, F.lit("")) != "") & (text != "?")
    start = F.when(~has_host, F.array().cast(PARTS)).when(plain, F.array(part("lit", F.concat(text, F.lit("://"), F.try_element_at(host, F.lit(1))["text"])))).otherwise(F.array(part("origin")))
    head = F.try_element_at(path, F.lit(1))
    slash = has_host & (F.size(path) > 0) & ((head["kind"] != "lit") | ~head["text"].startswith("/"))
    url = merged(F.concat(start, F.when(slash, F.array(part("lit", F.lit("/")))).otherwise(F.array().cast(PARTS)), path))
    first = lambda x: F.try_element_at(x, F.lit(1))
    tails = F.forall(lists, lambda x: (F.size(x) == 0) | F.coalesce((first(x)["kind"] == "lit") & first(x)["text"].startswith("?"), F.lit(False)))
    tail = F.when(tails, F.array(part("tail"))).otherwise(F.array(part("val", ref=ref)))
    return F.when(op == "url", url).when(op == "tail", tail).when(op == "trim", _trimmed(all_parts, F.coalesce(text, F.lit("")) == "all")).otherwise(all_parts)


def unfolded(exprs: DataFrame, operands: DataFrame, values: DataFrame, objects: DataFrame, roots: DataFrame) -> list[DataFrame]:
    """The nodes of all levels: (root, id, parent, ord, op, text, ref), leaves with op lit or val."""
    e = bucketed(exprs.select("expr", "op", "text", "object", "ref"), "exprs", "expr")
    below = operands.select("expr", "ord", "child", "text", F.lit(None).cast("string").alias("object"))
    below = below.union(values.select(F.lit(None).cast("string"), "ord", "child", F.when(F.col("child").isNull(), "").alias("text"), "object"))
    by_expr, by_object = bucketed(below.where("expr is not null").drop("object"), "operands", "expr"), bucketed(below.where("object is not null").drop("expr"), "values", "object")
    held = values.groupBy("object").agg(F.count("*").alias("n")).join(objects.where("closed").select("object"), "object", "left_anti")
    now = roots.select(F.col("expr").alias("root"), F.lit(0).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("ord"), F.col("expr"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("beyond"), F.lit(1).cast("long").alias("total"))
    now, out, used = stage(now.dropDuplicates(["root"]), "expressions"), [], None
    while not now.isEmpty():
        n = now.withColumnRenamed("text", "own").join(e, "expr", "left")
        leaf = F.when(F.col("own").isNotNull(), "lit").when(F.col("beyond") | F.col("op").isNull(), "val").otherwise(F.col("op"))
        n = n.withColumns({"op": leaf, "text": F.coalesce("own", "text")})
        variables = n.where("op = 'var'").join(held, "object")
        if used is not None:
            variables = variables.join(used.groupBy("root", "object").agg(F.sum("k").alias("k")), ["root", "object"], "left")
        else:
            variables = variables.withColumn("k", F.lit(0))
        nth = F.row_number().over(Window.partitionBy("root", "object").orderBy("id")) + F.coalesce("k", F.lit(0))
        variables = stage(variables.withColumn("nth", nth).where(F.col("nth") <= EACH).select("root", "id", "object", F.col("n").alias("held"), "total"), "expression-variables")
        k = variables.groupBy("root", "object").agg(F.count("*").alias("k"))
        used = stage(k if used is None else used.union(k), "expressions-used")
        n = n.join(variables.select("root", "id", "held"), ["root", "id"], "left")
        op = F.when(F.col("op") != "var", F.col("op")).when(F.col("held").isNull(), "val").when(F.col("held") == 1, "concat").otherwise("tail")
        level = stage(n.select("root", "id", "parent", "ord", op.alias("op"), "text", F.when(F.col("op").isin("var", "val"), F.col("ref")).alias("ref"), "expr", "total"), "expression-level")
        out.append(level)
        inner = level.where("op NOT IN ('lit', 'val')").join(variables.select("root", "id"), ["root", "id"], "left_anti").select("expr", "root", F.col("id").alias("parent"), "total", (F.col("op") == "format").alias("free"))
        next_ = inner.join(by_expr, "expr").select("root", "parent", "ord", "child", "text", "total", "free")
        next_ = next_.union(variables.select("object", "root", F.col("id").alias("parent"), "total").join(by_object, "object").select("root", "parent", "ord", "child", "text", "total", F.lit(False)))
        numbered = next_.withColumn("id", F.col("total") + F.row_number().over(Window.partitionBy("root").orderBy("parent", "ord")) - 1)
        beyond = (F.col("id") >= MOST) & ~F.col("free") & F.col("text").isNull()
        numbered = numbered.withColumn("total", F.col("total") + F.count("*").over(Window.partitionBy("root")))
        now = stage(numbered.select("root", "id", "parent", F.col("ord").cast("int").alias("ord"), F.col("child").alias("expr"), F.when((F.col("id") >= MOST) & ~F.col("free"), None).otherwise(F.col("text")).alias("text"), (beyond | ((F.col("id") >= MOST) & ~F.col("free"))).alias("beyond"), "total"), "expressions")
    return out


def evaluated(exprs: DataFrame, operands: DataFrame, values: DataFrame, objects: DataFrame, roots: DataFrame) -> DataFrame:
    """(expr, parts) of ``roots`` (expr).

    ``exprs`` (expr, op, text, object, ref) have an op: lit (a text), var (an object), val (a value that is not
    known, of a reference), concat, format (operands that are pieces of a format), trim (its last slash, or all if
    the text says ``all``), url (host and path as operands 0 and 1, the scheme as text, ``?`` if it is not constant). Any other
    is a value. ``operands`` (expr, ord, child, text) are expressions or plain texts. A variable is its
    one assigned value of ``values`` (object, ord, child; no child is the empty text), a query tail if it has several that are
    empty or start with a question mark, and else a value; ``objects`` (object, closed) say whose writes are not all known.
    """
    known = exprs.withColumn("op", F.when(F.col("op").isin("lit", "var", "concat", "format", "trim", "url"), F.col("op")).otherwise("val"))
    levels = unfolded(known, operands, values, objects, roots)
    up, none = None, F.array().cast(PARTS)
    for level in reversed(levels):
        leaf = F.when(F.col("op") == "lit", F.array(part("lit", F.coalesce("text", F.lit(""))))).when(F.col("op") == "val", F.array(part("val", ref=F.col("ref"))))
        if up is None:
            kids = F.array().cast(f"array<struct<ord:int,parts:{PARTS}>>")
        else:
            gathered = up.groupBy("root", F.col("parent").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "parts"))).alias("kids"))
            level = level.join(gathered, ["root", "id"], "left")
            kids = F.coalesce("kids", F.array().cast(f"array<struct<ord:int,parts:{PARTS}>>"))
        parts = F.coalesce(leaf, _folded(F.col("op"), kids, F.col("text"), F.col("ref")), none)
        up = stage(level.select("root", "parent", "ord", merged(parts).cast(PARTS).alias("parts")), "expression-parts")
    if up is None:
        return roots.select("expr", none.alias("parts")).limit(0)
    return up.select(F.col("root").alias("expr"), "parts")


def spelt(parts: Column) -> Column:
    """Parts as one text: values as ``{}``, an origin as ``{origin}``, a query tail as ``{?}``."""
    show = lambda p: F.when(p["kind"] == "lit", p["text"]).when(p["kind"] == "val", "{}").when(p["kind"] == "origin", "{origin}").otherwise("{?}")
    return F.array_join(F.transform(parts, show), "")
