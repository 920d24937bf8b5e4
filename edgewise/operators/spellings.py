"""Type spellings under a byte cap, over a shared graph of types.

A spelling is a list of parts, texts and other types. Written out, a chain of types that use the
one before twice doubles with each link; so lengths are counted first, from the leaves up,
each node once, and stop counting past the cap. A spelling within it is written whole, a
longer one as its first bytes and the digest of its structure, which shared parts enter by
their own digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.operators.reach import _union, bucketed, forget
from edgewise.session import stage

CAP, PREFIX = 64 << 10, 256
#: Fixed values of the document format: the mark before a digest, and the first byte of a text, a type and an open type in it.
MARK = "…sha256:"
TEXT, TYPE, OPEN = "73", "74", "63"

_PART = "struct<ord:int,size:long,digest:string,text:string>"


def varint(n: Column) -> Column:
    """Hex digits of a number in groups of seven bits, the lowest first, all but the last marked."""
    byte = lambda k, more: F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(127).bitwiseOR(128 if more else 0)), 2, "0")
    out = F.concat(*(byte(k, k < 4) for k in range(5)))
    for k in range(3, -1, -1):
        out = F.when(n < 1 << 7 * (k + 1), F.concat(*(byte(j, j < k) for j in range(k + 1)))).otherwise(out)
    return out


def _facts(parts: Column, alias: Column, cap: int) -> Column:
    """(size, digest, text) of a node by its ordered parts; an alias has the digest of what it stands for."""
    size = F.least(F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + p["size"]), F.lit(cap + 1).cast("long"))
    text = F.array_join(F.transform(parts, lambda p: p["text"]), "")
    digest = F.sha2(F.unhex(F.array_join(F.transform(parts, lambda p: p["digest"]), "")), 256)
    same = alias & (F.size(parts) == 1) & F.startswith(parts[0]["digest"], F.lit(TYPE))
    digest = F.when(same, F.substring(parts[0]["digest"], 3, 64)).otherwise(digest)
    # 256 letters are 256 bytes or more: of a long spelling nothing behind them is needed
    return F.struct(size.alias("size"), F.lower(digest).alias("digest"), F.when(size > cap, F.left(text, F.lit(PREFIX))).otherwise(text).alias("text"))


def measured(parts: DataFrame, cap: int = CAP) -> DataFrame:
    """(node, size, digest, text) of all nodes of ``parts`` (node, ord, text, child, and optionally alias).

    The size saturates one past the cap, and the text of a node past it is its start. In each round the nodes
    go whose types all are known, so there are as many rounds as the graph is deep, and each
    node is handed to its users once. A node on a cycle, or above one, has no end: it is past the
    cap, and a type that it cannot know enters its digest as open.
    """
    alias = F.coalesce("alias", F.lit(False)) if "alias" in parts.columns else F.lit(False)
    parts = parts.select("node", F.col("ord").cast("int").alias("ord"), "text", "child", alias.alias("alias"))
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    literal = F.struct("ord", n.alias("size"), F.concat(F.lit(TEXT), varint(n), F.hex(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest"), F.coalesce("text", F.lit("")).alias("text")).cast(_PART)
    known = parts.select("node").distinct()
    gone = parts.where("child is not null").select("child").distinct().join(known, F.col("child") == F.col("node"), "left_anti").select(F.col("child").alias("node"))
    nodes = parts.groupBy("node").agg(F.collect_list(F.when(F.col("child").isNull(), literal)).alias("literals"), F.count("child").alias("children"), F.bool_or("alias").alias("alias"))
    nodes = nodes.union(gone.select("node", F.array().cast(f"array<{_PART}>"), F.lit(0).cast("long"), F.lit(False)))  # a type without parts is an empty text
    nodes = bucketed(nodes, "type_nodes", "node")
    uses = bucketed(parts.where("child is not null").select("child", "node", "ord"), "type_uses", "child")
    none = F.array().cast(f"array<{_PART}>")
    state = bucketed(nodes.select("node", none.alias("held"), F.lit(False).alias("done")).where("false"), "type_parts", "node")
    now = nodes.where("children = 0").select("node", _facts(F.array_sort("literals"), F.col("alias"), cap).alias("f"))
    done = [stage(now.select("node", "f.*"), "spelt")]
    while not done[-1].isEmpty():
        fresh = done[-1].select(F.col("node").alias("child"), "size", F.concat(F.lit(TYPE), F.upper("digest")).alias("digest"), "text")
        come = uses.join(fresh, "child").groupBy("node").agg(F.collect_list(F.struct("ord", "size", "digest", "text")).alias("come"))
        held = F.concat(F.coalesce("held", none), F.coalesce("come", none).cast(f"array<{_PART}>"))
        after = come.join(state.where("NOT done").drop("done"), "node", "full_outer").select("node", held.alias("held"))
        after = after.join(nodes.select("node", F.col("children").alias("_n")), "node").select("node", "held", (F.size("held") == F.col("_n")).alias("done"))
        after = bucketed(after, "type_parts", "node")
        forget(state)
        state = after
        ready = state.where("done").join(nodes, "node").select("node", _facts(F.array_sort(F.concat("literals", "held")), F.col("alias"), cap).alias("f"))
        done.append(stage(ready.select("node", "f.*"), "spelt"))
    all_done = _union(done)
    left = nodes.join(all_done.select("node"), "node", "left_anti").join(state.where("NOT done").select("node", "held"), "node", "left")
    lacking = uses.join(left.select("node"), "node", "left_semi").join(all_done.select(F.col("node").alias("child")), "child", "left_anti")
    open_ = lacking.groupBy("node").agg(F.collect_list(F.struct("ord", F.lit(cap + 1).cast("long").alias("size"), F.lit(OPEN).alias("digest"), F.lit("").alias("text"))).alias("open"))
    ends = left.join(open_, "node", "left").select("node", _facts(F.array_sort(F.concat("literals", F.coalesce("held", none), F.coalesce("open", none).cast(f"array<{_PART}>"))), F.col("alias"), cap).alias("f"))
    ends = ends.select("node", F.lit(cap + 1).cast("long").alias("size"), "f.digest", F.left("f.text", F.lit(PREFIX)).alias("text"))
    return all_done.union(ends)


def spellings(parts: DataFrame, cap: int = CAP) -> DataFrame:
    """(node, spelling, cut): the whole spelling, or PREFIX bytes of it, whole letters, and the digest."""
    fits = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(PREFIX)), lambda k: F.octet_length(F.left("text", k)) <= PREFIX))
    cut = F.concat(F.left("text", fits), F.lit(MARK), "digest")
    return measured(parts, cap).select("node", F.when(F.col("size") > cap, cut).otherwise(F.col("text")).alias("spelling"), (F.col("size") > cap).alias("cut"))
