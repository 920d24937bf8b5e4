"""Relational tables as a dependency graph: stocks call the next stock of the same order.

Vertices are stocks (symbols: a part from a nation, in the package of the part's brand),
brands and market segments (packages). An edge leads from the stock of each order line to
that of the next line; its kind follows the return flag, its position is the order line.
Brands own their stocks. A brand imports another one if it calls that at least as often as
it is called by it, and a segment imports the brands that its customers order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgewise.graph import Graph, Meta, graph, merge_edges
from edgewise.session import read_table, stage

TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order line, written once: src, dst (null on the last line of an order), kind, position, candidate, shipped, order."""
    of = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", *TIES).join(of, "l_suppkey")
    stock = F.concat(F.lit("part/"), F.col("l_partkey"), F.lit("/n"), F.col("s_nationkey"))
    rows = rows.withColumn("stock", stock).withColumn("next", F.lead("stock").over(Window.partitionBy("l_orderkey").orderBy(*TIES)))
    kind = F.when(F.col("l_returnflag") == "R", "call").when(F.col("l_returnflag") == "A", "references").otherwise("signature")
    position = F.struct(F.concat(F.lit("orders/"), F.col("l_orderkey")).alias("file"), F.col("l_linenumber").alias("line"), F.lit(0).alias("column"))
    rows = rows.select(F.col("stock").alias("src"), F.col("next").alias("dst"), kind.alias("kind"), position.alias("position"), (F.col("l_suppkey") % 4 == 0).alias("candidate"), F.col("l_shipdate").alias("shipped"), F.col("l_orderkey").alias("order"))
    return stage(rows, "order-lines")


def stocks(spark: SparkSession, sf_dir: str, raw: DataFrame) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 5 == 0, "type").when(F.col("p_partkey") % 5 == 1, "method").otherwise("func")
    p = p.select(
        F.col("p_partkey").alias("_key"), kind.alias("kind"), F.col("p_name").alias("name"), F.concat(F.lit("brand/"), "p_brand").alias("package"),
        (F.col("p_size") % 2 == 0).alias("exported"), (F.col("p_size") % 7 == 0).alias("generated"), (F.col("p_size") % 3 == 0).alias("interface"),
    )
    ids = raw.select(F.col("src").alias("id")).distinct().withColumn("_key", F.split_part("id", F.lit("/"), F.lit(2)).cast("long"))
    return ids.join(p, "_key").drop("_key")


def imports(spark: SparkSession, sf_dir: str, raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst): net calls between brands, and orders of segments."""
    owner = symbols.select(F.col("id").alias("src"), F.col("package").alias("a")), symbols.select(F.col("id").alias("dst"), F.col("package").alias("b"))
    calls = raw.where("kind = 'call' AND dst is not null").join(owner[0], "src").join(owner[1], "dst").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    back = calls.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    net = calls.join(back, ["a", "b"], "left").where("n >= coalesce(m, 0)").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    orders, customers = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    buyers = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("order"), F.concat(F.lit("segment/"), "c_mktsegment").alias("s"))
    bought = raw.join(owner[0], "src").select("order", "a").distinct().join(buyers, "order").select("s", "a").distinct()
    return net.union(bought)


def part_graph(spark: SparkSession, sf_dir: str, only=None, raw: DataFrame | None = None, positions: bool = True) -> Graph:
    """The graph of all order lines, its edges written once; with ``only`` the relations of the lines that meet it.
    Queries that look at no position go without them."""
    raw = lines(spark, sf_dir) if raw is None else raw
    symbols = stage(stocks(spark, sf_dir, raw), "stocks")
    packages = symbols.select(F.col("package").alias("id")).union(read_table(spark, sf_dir, "customer").select(F.concat(F.lit("segment/"), "c_mktsegment"))).distinct()
    packages = packages.select("id", F.lit("package").alias("kind"), F.col("id").alias("name"))
    raw = raw if only is None else raw.where(only)
    none = F.lit(None).cast("array<struct<file:string,line:int,column:int>>").alias("positions")
    calls = raw.where("dst is not null")
    if positions:
        calls = merge_edges(calls.select("src", "dst", "kind", F.array("position").alias("positions"), "candidate"))
    else:
        calls = calls.groupBy("src", "dst", "kind").agg(F.bool_and("candidate").alias("candidate")).select("src", "dst", "kind", none, "candidate")
    edges = calls.union(symbols.select("package", "id", F.lit("contains"), none, F.lit(False))).union(imports(spark, sf_dir, raw, symbols).select("src", "dst", F.lit("import"), none, F.lit(False)))
    return graph(symbols.unionByName(packages, allowMissingColumns=True), stage(edges, "edges"), Meta(level="symbol"))


#: The same graph for DuckDB.
SQL = """
seq AS (
  SELECT l.*, 'part/' || l_partkey || '/n' || s_nationkey AS stock, 'brand/' || p_brand AS package,
    lead('part/' || l_partkey || '/n' || s_nationkey) OVER o AS nxt, lead('brand/' || p_brand) OVER o AS nxt_package
  FROM lineitem l JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
  WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)
), lines AS MATERIALIZED (
  SELECT stock AS src, nxt AS dst,
    CASE l_returnflag WHEN 'R' THEN 'call' WHEN 'A' THEN 'references' ELSE 'signature' END AS kind,
    'orders/' || l_orderkey AS file, l_linenumber AS line, l_suppkey % 4 = 0 AS candidate, l_shipdate AS shipped, l_orderkey AS ord,
    package AS src_package, nxt_package AS dst_package FROM seq
), raw AS (
  SELECT * FROM lines WHERE dst IS NOT NULL
), vertices AS MATERIALIZED (
  SELECT id, CASE WHEN p_partkey % 5 = 0 THEN 'type' WHEN p_partkey % 5 = 1 THEN 'method' ELSE 'func' END AS kind,
    'brand/' || p_brand AS package, p_size % 2 = 0 AS exported, p_size % 3 = 0 AS interface
  FROM (SELECT DISTINCT src AS id FROM lines) JOIN part ON p_partkey = CAST(split_part(id, '/', 2) AS BIGINT)
  UNION ALL SELECT DISTINCT 'brand/' || p_brand, 'package', NULL, false, false FROM part WHERE p_partkey IN (SELECT l_partkey FROM seq)
  UNION ALL SELECT DISTINCT 'segment/' || c_mktsegment, 'package', NULL, false, false FROM customer
), brand_calls AS MATERIALIZED (
  SELECT src_package AS src, dst_package AS dst, count(*) AS n FROM raw WHERE kind = 'call' AND src_package <> dst_package GROUP BY ALL
), imports AS MATERIALIZED (
  SELECT x.src, x.dst FROM brand_calls x LEFT JOIN brand_calls y ON y.src = x.dst AND y.dst = x.src WHERE x.n >= coalesce(y.n, 0)
  UNION ALL SELECT DISTINCT 'segment/' || c_mktsegment, l.src_package FROM lines l JOIN orders ON o_orderkey = l.ord JOIN customer ON c_custkey = o_custkey
), edges AS MATERIALIZED (
  SELECT src, dst, kind, bool_and(candidate) AS candidate, count(DISTINCT (file, line)) AS n, min((file, line)) AS first FROM raw GROUP BY src, dst, kind
  UNION ALL SELECT package, id, 'contains', false, 0, NULL FROM vertices WHERE package IS NOT NULL
  UNION ALL SELECT src, dst, 'import', false, 0, NULL FROM imports
), deps AS MATERIALIZED (
  SELECT DISTINCT src, dst FROM edges WHERE kind <> 'contains'
), root AS (
  SELECT src AS id FROM deps WHERE src LIKE 'part/%' GROUP BY src ORDER BY count(*) DESC, src LIMIT 1
)
"""
