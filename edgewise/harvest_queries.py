"""Registered queries of what a harvest says about itself, from the part and order tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewise import graph as G
from edgewise.queries import query
from edgewise.session import read_table
from edgewise.sources import harvest


def _packages(spark, sf_dir):
    """A package a part: its module is the brand, main for even sizes; PROMO parts are loaded with an error and without a name."""
    p, promo = read_table(spark, sf_dir, "part"), F.col("p_type") == "PROMO"
    return p.select(
        F.concat(F.lit("p"), "p_partkey").alias("id"), F.when(~promo, F.col("p_name")).alias("name"), F.when(~promo, F.col("p_brand")).alias("module"), F.concat(F.lit("/src/"), "p_brand").alias("module_dir"),
        (~promo & (F.col("p_size") % 2 == 0)).alias("main"), F.when(promo, 0).otherwise(F.col("p_size")).alias("n_files"),
        F.when(promo | (F.col("p_size") % 5 == 0), F.array(F.concat(F.lit("no package "), "p_name", F.lit("; to add it:\n\tget it")))).alias("errors"),
    )


@query("SELECT DISTINCT p_brand AS path, '/src/' || p_brand AS dir FROM part WHERE p_type <> 'PROMO' AND p_size % 2 = 0", on_graph=False)
def workspace_modules(spark, sf_dir):
    return harvest.workspace_modules(_packages(spark, sf_dir), "Brand#1")[0]


@query("SELECT 'p' || p_partkey AS id, p_brand AS module FROM part WHERE p_type <> 'PROMO' AND p_size % 2 = 0 AND p_brand <> 'Brand#1'", on_graph=False)
def workspace_packages(spark, sf_dir):
    return harvest.workspace_modules(_packages(spark, sf_dir), "Brand#1")[1]


@query("SELECT 'p' || p_partkey AS id, 'no package ' || p_name AS message FROM part WHERE p_type = 'PROMO'", on_graph=False)
def pattern_errors(spark, sf_dir):
    return harvest.pattern_errors(_packages(spark, sf_dir))[1]


_OMITTED = """
WITH loaded AS (SELECT 'p' || p_partkey AS id, 'p' || (p_partkey - CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END) AS package, p_type NOT IN ('PROMO', 'LARGE') AS kept, p_type = 'LARGE' AS excluded, p_size % 3 AS ignored, p_size % 10 = 0 AS failed FROM part),
of AS (SELECT package, bool_or(kept) AS kept, bool_or(excluded) AS excluded FROM loaded GROUP BY package),
seq AS (SELECT 'p' || l_partkey AS src, 'p' || lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem),
imported AS (SELECT DISTINCT l.package AS src, s.dst FROM seq s JOIN loaded l ON l.id = s.src JOIN of o ON o.package = l.package AND o.kept WHERE s.dst IS NOT NULL),
lost AS (SELECT coalesce(o.excluded, false) AS excluded FROM imported i LEFT JOIN of o ON o.package = i.dst WHERE NOT coalesce(o.kept, false)),
mine AS (SELECT l.* FROM loaded l JOIN of o ON o.package = l.package AND o.kept)
SELECT what, n FROM (SELECT 'imports of excluded packages' AS what, count(*) AS n FROM lost WHERE excluded UNION ALL SELECT 'imports outside the module', count(*) FROM lost WHERE NOT excluded
  UNION ALL SELECT 'packages with load errors', count(DISTINCT package) FROM mine WHERE failed UNION ALL SELECT 'test variants merged', count(*) FROM mine WHERE id <> package
  UNION ALL SELECT 'files of other builds', CAST(sum(m) AS BIGINT) FROM (SELECT max(ignored) AS m FROM mine GROUP BY package)) WHERE n > 0
"""


@query(_OMITTED, on_graph=False)
def omissions(spark, sf_dir):
    """Parts as loaded packages, those of every seventh size as test variants of the part before them; imports follow order lines."""
    from pyspark.sql.window import Window

    p, size, kind = read_table(spark, sf_dir, "part"), F.col("p_size"), F.col("p_type")
    base = F.col("p_partkey") - F.when(size % 7 == 0, 1).otherwise(0)
    name = lambda c: F.concat(F.lit("p"), c)
    loaded = p.select(name("p_partkey").alias("id"), name(base).alias("package"), (~kind.isin("PROMO", "LARGE")).alias("kept"), (kind == "LARGE").alias("excluded"), (size % 3).alias("ignored"), (size % 10 == 0).alias("failed"))
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    then = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    imports = lines.select(name("l_partkey").alias("src"), name(then).alias("dst")).where("dst is not null")
    return harvest.omissions(loaded, imports)


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, CASE o_orderstatus WHEN 'O' THEN '/work/app/' WHEN 'F' THEN '/work/doc/' ELSE '/lib/' END || o_custkey || CASE WHEN o_orderkey % 11 = 0 THEN '/../x.go' ELSE '/x.go' END AS file FROM orders),
v AS (SELECT 'm/o' || k AS id, CASE WHEN file LIKE '%/../%' OR file LIKE '/lib/%' OR k % 4 = 0 THEN NULL WHEN s = 'O' THEN substr(file, 11) ELSE substr(file, 11) END AS path, k % 4 AS line FROM o)
SELECT id, id AS usr, substr(id, 3) AS qualified_name, 'func' AS kind, path, CASE WHEN path IS NOT NULL THEN line END AS line FROM v UNION ALL SELECT 'none/' || c_custkey, NULL, NULL, NULL, NULL, NULL FROM customer""", on_graph=False)
def symbolize(spark, sf_dir):
    """Orders as symbols, below the project, the document's root or neither; customers are asked for and are none."""
    o = read_table(spark, sf_dir, "orders")
    base = F.when(F.col("o_orderstatus") == "O", "/work/app/").when(F.col("o_orderstatus") == "F", "/work/doc/").otherwise("/lib/")
    file = F.concat(base, "o_custkey", F.when(F.col("o_orderkey") % 11 == 0, "/../x.go").otherwise("/x.go"))
    at = F.struct(file.alias("file"), (F.col("o_orderkey") % 4).cast("int").alias("line"), F.lit(-1).alias("column"))
    v = o.select(F.concat(F.lit("m/o"), "o_orderkey").alias("id"), F.lit("func").alias("kind"), at.alias("position"))
    g = G.graph(v, spark.createDataFrame([], G.EDGE), G.Meta(root="/work/doc"))
    ids = v.select("id").union(read_table(spark, sf_dir, "customer").select(F.concat(F.lit("none/"), "c_custkey")))
    return harvest.symbols_of(g, ids, "/work/app").select("id", "usr", "qualified_name", "kind", "path", F.col("line").cast("long").alias("line"))


_TREES = """
WITH files AS (SELECT side, p_brand || '/' || p_type || '/f' || p_partkey AS file, '100644' AS mode, sha256(p_name || CASE WHEN side = 'after' AND p_size % 10 = 0 THEN '!' ELSE '' END) AS sha256
  FROM part, (VALUES ('before'), ('after')) t(side) WHERE NOT (side = 'after' AND p_size % 13 = 0)),
lines AS (SELECT side, file, sha256(strlen(file) || ':' || file || ':' || mode || ':' || sha256 || chr(10)) AS d FROM files),
word AS (SELECT side, file, k, CAST('0x' || substr(d, CAST(8 * k + 1 AS BIGINT), 8) AS BIGINT) AS w FROM lines, range(8) r(k))"""


def _captures(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    one = lambda text, keep: p.where(keep).select(F.concat_ws("/", "p_brand", "p_type", F.concat(F.lit("f"), "p_partkey")).alias("file"), F.lit("100644").alias("mode"), F.sha2(text.cast("binary"), 256).alias("sha256"))
    return one(F.col("p_name"), F.lit(True)), one(F.concat("p_name", F.when(F.col("p_size") % 10 == 0, "!").otherwise("")), F.col("p_size") % 13 != 0)


@query(f"""{_TREES}, sums AS (SELECT folder, k, sum(w) AS w, count(*) AS n FROM (SELECT '' AS folder, * FROM word WHERE side = 'before' UNION ALL SELECT split_part(file, '/', 1), * FROM word WHERE side = 'before'
  UNION ALL SELECT split_part(file, '/', 1) || '/' || split_part(file, '/', 2), * FROM word WHERE side = 'before') GROUP BY folder, k)
SELECT folder, max(n) AS files, sha256(max(n) || ':' || string_agg(CAST(w AS VARCHAR), ':' ORDER BY k)) AS digest FROM sums GROUP BY folder""", on_graph=False)
def capture_tree(spark, sf_dir):
    return harvest.capture_tree(_captures(spark, sf_dir)[0])


@query("""WITH files AS (SELECT side, p_brand || '/' || p_type AS folder, p_partkey, p_name || CASE WHEN side = 'after' AND p_size % 10 = 0 THEN '!' ELSE '' END AS text
  FROM part, (VALUES ('before'), ('after')) t(side) WHERE NOT (side = 'after' AND p_size % 13 = 0)),
folders AS (SELECT side, folder, list((p_partkey, text) ORDER BY p_partkey) AS held FROM files GROUP BY ALL)
SELECT coalesce(a.folder, b.folder) AS folder, CASE WHEN a.folder IS NULL THEN 'added' WHEN b.folder IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM folders WHERE side = 'before') a FULL JOIN (SELECT * FROM folders WHERE side = 'after') b ON a.folder = b.folder WHERE a.held IS DISTINCT FROM b.held""", on_graph=False)
def differing_folders(spark, sf_dir):
    return harvest.differing_folders(*_captures(spark, sf_dir))


@query("""SELECT o_orderkey AS n, CASE WHEN c_mktsegment = 'BUILDING' THEN '{}' ELSE 'https://' || c_mktsegment END || '/v1/' || CASE WHEN o_orderkey % 3 = 0 THEN '{}' ELSE CAST(o_orderkey AS VARCHAR) END || '/' || o_orderpriority
  || CASE WHEN o_orderstatus = 'P' THEN '{}' ELSE '{?}' END AS url FROM orders JOIN customer ON c_custkey = o_custkey""", on_graph=False)
def url_expressions(spark, sf_dir):
    """A URL an order: a base by segment (of which one may be set elsewhere too), a format of the key, where known, and the priority,
    whose last slash is cut, and a query by status, of several values."""
    from edgewise.operators.expressions import evaluated, spelt

    o = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    none = F.lit(None).cast("string")
    id = lambda c: F.concat(F.lit(c), "o_orderkey")
    expr = lambda e, op, text=none, obj=none: F.struct(e.alias("expr"), F.lit(op).alias("op"), text.alias("text"), obj.alias("object"), none.alias("ref"))
    key = F.when(F.col("o_orderkey") % 3 == 0, expr(id("k"), "val")).otherwise(expr(id("k"), "lit", F.col("o_orderkey").cast("string")))
    rows = F.array(
        expr(id("o"), "concat"), expr(id("b"), "var", obj=F.concat(F.lit("base "), "c_mktsegment")), expr(id("f"), "format"), key, expr(id("t"), "trim"),
        expr(id("p"), "lit", F.concat("o_orderpriority", F.lit("/"))), expr(id("q"), "var", obj=F.concat(F.lit("query "), "o_orderstatus")),
    )
    at = lambda e, n, child, text=None: F.struct(e.alias("expr"), F.lit(n).alias("ord"), (none if child is None else child).alias("child"), F.lit(text).cast("string").alias("text"))
    operands = F.array(at(id("o"), 0, id("b")), at(id("o"), 1, id("f")), at(id("o"), 2, id("q")), at(id("f"), 0, None, "/v1/"), at(id("f"), 1, id("k")), at(id("f"), 2, None, "/"), at(id("f"), 3, id("t")), at(id("t"), 0, id("p")))
    bases = o.select("c_mktsegment").distinct().select(F.concat(F.lit("base "), "c_mktsegment").alias("object"), F.lit(0).alias("ord"), F.concat(F.lit("https://"), "c_mktsegment").alias("child"))
    queries = o.select("o_orderstatus").distinct().select(F.concat(F.lit("query "), "o_orderstatus").alias("object"), F.explode(F.array(F.struct(F.lit(0).alias("ord"), none.alias("child")), F.struct(F.lit(1).alias("ord"), F.concat(F.lit("?"), "o_orderstatus").alias("child")))).alias("v")).select("object", "v.*")
    texts = bases.select(F.col("child").alias("expr"), "child").union(queries.where("child is not null").select("child", F.when(F.col("object") == "query P", "page").otherwise(F.col("child"))))
    exprs = o.select(F.explode(rows).alias("e")).select("e.*").union(texts.select("expr", F.lit("lit"), F.col("child"), none, none))
    objects = bases.select("object", (F.col("object") == "base BUILDING").alias("closed"))
    out = evaluated(exprs, o.select(F.explode(operands).alias("x")).select("x.*"), bases.union(queries), objects, o.select(id("o").alias("expr")))
    return out.select(F.expr("substring(expr, 2)").cast("long").alias("n"), spelt(F.col("parts")).alias("url"))
