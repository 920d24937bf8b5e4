"""Further registered queries: fact tables, documents' attributes, URLs and patterns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from edgewise import graph as G
from edgewise.functions import templates, urls
from edgewise.functions.ids import short_name
from edgewise.operators import diff, queries, rules
from edgewise.plans.project import lines, part_graph
from edgewise.queries import _COMP, ORACLE_SQL, QUERIES, ROOTS_SQL, RULES, _part, _root, _roots, _stock, _text, query
from edgewise.session import read_table
from edgewise.sources import documents

__all__ = ["ORACLE_SQL", "QUERIES"]


def _rows(df, schema: str, f):
    """Rows of ``df`` through the text function ``f``, batch by batch."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = [f(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return df.mapInArrow(run, schema)


@query("SELECT (SELECT count(*) FROM vertices) AS vertices, (SELECT count(*) FROM edges) AS edges")
def summary_counts(spark, sf_dir):
    s = G.summary(part_graph(spark, sf_dir))
    return spark.createDataFrame([(s["vertices"], s["edges"])], "vertices long, edges long")


@query("SELECT e.dst AS id, e.kind FROM edges e JOIN root r ON e.src = r.id WHERE e.dst = (SELECT min(dst) FROM edges JOIN root ON src = id)")
def edge_kinds_of_pair(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    root = _root(g)
    dst = g.edges.where(F.col("src") == root).agg(F.min("dst")).first()[0]
    return G.edge_kinds(g, root, dst).select(F.lit(dst).alias("id"), "kind")


@query("SELECT id, CASE WHEN kind = 'package' THEN coalesce(nullif(regexp_replace(id, '^brand/', ''), id), id) END AS path, NOT starts_with(id, 'brand/') AS is_external FROM vertices WHERE kind = 'package'")
def module_paths(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    return rules.packages(g.with_(meta=G.Meta(module="brand"))).select("id", "path", "is_external")


@query("SELECT id FROM vertices WHERE kind <> 'package' AND exported UNION SELECT id FROM vertices WHERE id IN (SELECT id FROM root)")
def retention_roots(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    return queries.retention_roots(g.with_(meta=G.Meta(roots=[_root(g), "gone"])), public=True)[0]


def _dispatching(g):
    """Methods that outside interfaces may call, received by their package."""
    hop = (F.col("kind") == "method") & F.col("interface")
    v = g.vertices.withColumns({"satisfies": F.when(hop, F.array(F.lit("Out"))), "receiver": F.when(hop, F.col("package"))})
    return g.with_(vertices=v)


@query("SELECT package AS src, id AS dst FROM vertices WHERE kind = 'method' AND interface")
def external_hops(spark, sf_dir):
    return queries.external_hops(_dispatching(part_graph(spark, sf_dir))).select("src", "dst")


@query(f"""+ steps AS (SELECT src, dst FROM deps UNION SELECT package, id FROM vertices WHERE kind = 'method' AND interface),
{ROOTS_SQL}, reached AS (SELECT id FROM roots UNION SELECT package FROM vertices WHERE id IN (SELECT id FROM roots) AND package < 'brand/Brand#2'
  UNION SELECT d.dst FROM reached r JOIN steps d ON d.src = r.id) SELECT id, kind FROM vertices WHERE kind <> 'package' AND id NOT IN (SELECT id FROM reached)""")
def unreachable_with_hops(spark, sf_dir):
    g = _dispatching(part_graph(spark, sf_dir))
    roots = [r.id for r in _roots(g).collect()]
    owners = [r.package for r in g.vertices.join(_roots(g), "id").where("package < 'brand/Brand#2'").select("package").distinct().collect()]
    return queries.unreachable(g, extra=roots + owners).select("id", "kind")


def _changed(g):
    """A later snapshot: other kinds, marks and field lists, by part."""
    n = F.when(_stock("id"), _part())
    v = g.vertices.withColumns({
        "kind": F.when((n % 10 == 3) & (F.col("kind") == "func"), "var").otherwise(F.col("kind")), "exported": F.when(n % 10 == 4, ~F.col("exported")).otherwise(F.col("exported")),
        "fields": F.when(F.col("kind") == "type", F.array(F.concat(F.lit("B:t"), (n % 4).cast("string")), F.lit("c:int"), F.lit("D:int"))),
    })
    return g.with_(vertices=v)


@query("""SELECT id, 'kind' AS field, 'func' AS "from", 'var' AS "to" FROM vertices WHERE kind = 'func' AND split_part(id, '/', 2)::INT % 10 = 3
UNION ALL SELECT id, 'exported', exported::VARCHAR, (NOT exported)::VARCHAR FROM vertices WHERE kind <> 'package' AND TRY_CAST(split_part(id, '/', 2) AS INT) % 10 = 4""")
def attribute_changes(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    return diff.attribute_changes(g, _changed(g))


@query("""SELECT id, 'D' AS added, 'A' AS removed, CASE WHEN split_part(id, '/', 2)::INT % 3 <> split_part(id, '/', 2)::INT % 4 THEN 'B' ELSE '' END AS retyped, true AS reordered FROM vertices WHERE kind = 'type'""")
def field_changes(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    before = F.array(F.lit("c:int"), F.concat(F.lit("B:t"), (F.when(_stock("id"), _part()) % 3).cast("string")), F.lit("A:int"))
    old = g.with_(vertices=g.vertices.withColumn("fields", F.when(F.col("kind") == "type", before)))
    return diff.field_changes(old, _changed(g)).select("id", _text("added"), _text("removed"), _text("retyped"), "reordered")


@query("""SELECT id, '"int"' AS "from", CASE WHEN p % 7 = 0 THEN 'any type' ELSE '"int"; "s' || p % 7 || '"' END AS "to" FROM (SELECT id, split_part(id, '/', 2)::INT AS p FROM vertices WHERE kind = 'type' AND interface AND exported)""")
def type_set_changes(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    n = F.when(_stock("id"), _part()) % 7
    meta = G.Meta(interfaceTypeSets=True)
    side = lambda c: g.with_(vertices=g.vertices.withColumn("typeSet", F.when(F.col("kind") == "type", c)), meta=meta)
    return diff.type_set_changes(side(F.array(F.lit("int"))), side(F.when(n > 0, F.array(F.lit("int"), F.concat(F.lit("s"), n.cast("string"))))))


@query(f"""+ {_COMP}, broken AS (SELECT i.src, i.dst, a.component AS fc, b.component AS tc FROM imports i JOIN comp a ON a.id = i.src JOIN comp b ON b.id = i.dst WHERE a.component = 'rest' AND b.component = 'second')
SELECT 'deny|import|' || src || '|' || dst || '|' || fc || '|' || tc AS key FROM broken""")
def baseline_keys(spark, sf_dir):
    v = rules.edge_violations(part_graph(spark, sf_dir), RULES).where("rule = 'deny' and kind = 'import'")
    return v.select(F.replace(diff.violation_key(), F.lit("\0"), F.lit("|")).alias("key"))


@query("""SELECT coalesce(o.o_orderkey, n.o_orderkey) AS n FROM (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW') o
FULL JOIN (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderpriority <> '1-URGENT') n USING (o_orderkey)
WHERE o.o_orderstatus IS DISTINCT FROM n.o_orderstatus""", on_graph=False)
def changed_files(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    capture = lambda df, mode: df.select(F.col("o_orderkey").cast("string").alias("file"), mode.alias("mode"), F.lit("x").alias("sha256"))
    before = capture(o.where("o_orderpriority <> '5-LOW'"), F.col("o_orderstatus"))
    after = capture(o.where("o_orderpriority <> '1-URGENT'"), F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("o_orderstatus")))
    return queries.changed_files(before, after).select(F.col("file").cast("long").alias("n"))


@query("""WITH has AS (SELECT DISTINCT l_partkey AS p, s_nationkey AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), want AS (SELECT n_regionkey AS r, n_nationkey AS n FROM nation),
size AS (SELECT r, count(*) AS k FROM want GROUP BY r) SELECT 'part/' || p AS src, 'region/' || r AS dst FROM has JOIN want USING (n) JOIN size USING (r) GROUP BY p, r, k HAVING count(*) = k""", on_graph=False)
def implements(spark, sf_dir):
    """Parts that are stocked in every nation of a region: relational division."""
    stock = lines(spark, sf_dir).select(F.regexp_replace("src", "/n[0-9]+$", "").alias("id"), F.regexp_extract("src", "n([0-9]+)$", 1).alias("method"))
    nation = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("region/"), "n_regionkey").alias("id"), F.col("n_nationkey").cast("string").alias("method"))
    return documents.implements(stock, nation).select("src", "dst")


@query("""WITH calls AS (SELECT DISTINCT 'nation/' || c_nationkey AS src, 'part/' || l_partkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
impl AS (SELECT DISTINCT 'part/' || l_partkey AS dst, 'part/' || l_partkey || '/n' || s_nationkey AS impl FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT src, impl AS dst FROM calls JOIN impl USING (dst)""", on_graph=False)
def dispatch(spark, sf_dir):
    raw = lines(spark, sf_dir)
    buyers = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("order"), F.concat(F.lit("nation/"), "c_nationkey").alias("src"))
    part = F.regexp_replace("src", "/n[0-9]+$", "")
    calls = raw.select("order", part.alias("dst")).join(buyers, "order").select("src", "dst").distinct()
    return documents.dispatch(calls, raw.select(part.alias("dst"), F.col("src").alias("impl")).distinct()).select("src", "dst")


@query("SELECT DISTINCT 'segment/' || c_mktsegment AS module FROM customer", on_graph=False)
def unused_requires(spark, sf_dir):
    """Brands and segments are required, parts are imported by their paths: the segments are unused."""
    p = read_table(spark, sf_dir, "part")
    modules = p.select(F.concat(F.lit("brand/"), "p_brand")).union(read_table(spark, sf_dir, "customer").select(F.concat(F.lit("segment/"), "c_mktsegment"))).distinct().toDF("module")
    imports = p.select(F.concat(F.lit("brand/"), "p_brand", F.lit("/part/"), "p_partkey").alias("path"), F.lit(None).cast("string").alias("module"))
    return documents.unused_requires(modules, imports).select("module")


@query("SELECT DISTINCT src AS package FROM lines WHERE kind = 'references' AND src NOT IN (SELECT src FROM lines WHERE kind = 'call')")
def test_only_imports(spark, sf_dir):
    raw = lines(spark, sf_dir)
    of = lambda kind: raw.where(F.col("kind") == kind).select(F.col("src").alias("package"))
    return documents.test_only_imports(of("call"), of("references"))


@query("SELECT DISTINCT src_package AS src, dst_package AS dst FROM raw WHERE src_package <> dst_package")
def module_imports(spark, sf_dir):
    raw = lines(spark, sf_dir)
    owner = part_graph(spark, sf_dir, raw=raw).vertices.where("package is not null").select("id", F.col("package").alias("module"))
    return documents.module_graph(owner, raw.where("dst is not null").select("src", "dst")).edges.select("src", "dst")


@query("SELECT src, dst, n AS n_positions FROM edges WHERE kind = 'call' AND NOT starts_with(src, 'part/7') AND NOT starts_with(dst, 'part/7')")
def package_imports(spark, sf_dir):
    """A package graph of the calls between stocks, without those that a pattern excludes."""
    raw = lines(spark, sf_dir)
    ids = raw.select(F.col("src").alias("id"), short_name(F.col("src")).alias("name"), F.lit("").alias("module"), F.lit(False).alias("external")).distinct()
    g = documents.package_graph(ids, raw.where("kind = 'call' AND dst is not null").select("src", "dst", "position").distinct(), ["part/7*/n*"])
    return g.edges.select("src", "dst", F.size("positions").cast("long").alias("n_positions"))


@query("""SELECT page_id, '/{}/{}/{}' AS slack, '/api/webhooks/{}/{}' AS discord, '/api/v' || page_id AS plain, '/k/{}' AS long FROM pages""", on_graph=False)
def url_masks(spark, sf_dir):
    def masks(n, key):
        of = lambda text: urls.compose_url([("lit", text)])["template"]
        return n, of(f"https://hooks.slack.com/services/T{n}/x"), of(f"https://Discord.com:443/api/webhooks/{n}/t{n}"), of(f"https://api.example.com/api/v{n}"), of(f"https://h/k/{key}")

    p = read_table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("a1"), F.md5("url")))
    return _rows(p, "page_id long, slack string, discord string, plain string, long string", masks)


@query("""SELECT page_id, '/{}/' || page_id AS template, '/' || page_id || '/{}/x' AS composed, 'https://h/x/' || page_id AS joined, '/b/' || page_id AS cleaned, 'a/' || page_id AS plain FROM pages""", on_graph=False)
def patterns_and_joins(spark, sf_dir):
    """Patterns of four frameworks with one template, and compositions and joins of URLs."""

    def row(n):
        render = templates.render
        made = {render(templates.parse_servemux(f"GET /{{lang}}/{n}")[2]), render(templates.parse_chi(f"/{{lang:[a-z]+}}/{n}")[0]), render(templates.parse_gin(f"/:lang/{n}")), render(templates.parse_echo(f"/:lang/{n}"))}
        composed = urls.compose_path([("lit", f"/{n}/"), ("val",), ("lit", "/x?q=1")])["template"]
        return n, "|".join(sorted(made)), composed, urls.join_path("https://h/a", "..", "x", str(n)), urls.resolve("/a/../b/", str(n)), urls.posix_join("a", "", ".", str(n), "b", "..")

    return _rows(read_table(spark, sf_dir, "pages").select("page_id"), "page_id long, template string, composed string, joined string, cleaned string, plain string", row)


@query("""SELECT DISTINCT p_type AS type, CASE p_partkey % 4 WHEN 0 THEN 'id' || p_size WHEN 1 THEN 'Name' || p_size ELSE 's' || p_size END AS "column", CASE WHEN p_type LIKE '%A%' THEN 't_' || p_type END AS relation FROM part WHERE p_partkey % 4 < 3""", on_graph=False)
def tag_columns(spark, sf_dir):
    from edgewise.functions.sqlrel import column_facts

    p, n = read_table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    text = lambda head, tail: F.concat(F.lit(head), "p_size", F.lit(tail))
    tag = F.when(n == 0, text('json:"x,db" db:"id', ',omitempty"')).when(n == 1, text('db:"" gorm:"size:9;COLUMN:Name', ';index"')).when(n == 2, text('sql:"s', '" gorm:"column:no"')).otherwise('db:"-" gorm:"column:x"')
    known = p.where("contains(p_type, 'A')").select(F.col("p_type").alias("type"), F.concat(F.lit("t_"), "p_type").alias("relation"))
    return column_facts(p.select(F.col("p_type").alias("type"), tag.alias("tag")), known)


@query("""SELECT p_partkey, 'src/' || p_brand || '/f' || p_size || '.go' AS inside, 'f' || p_size || '.go' AS outside, 'a/f' || p_size || '.go' AS relative FROM part""", on_graph=False)
def portable_files(spark, sf_dir):
    from edgewise.functions.ids import portable_file

    file = F.concat(F.lit("f"), "p_size", F.lit(".go"))
    of = lambda *x: portable_file(F.concat(*x), "/home/u/m")
    return read_table(spark, sf_dir, "part").select("p_partkey", of(F.lit("/home/u/m/src/"), F.col("p_brand"), F.lit("/"), file).alias("inside"), of(F.lit("C:\\lib\\"), file).alias("outside"), of(F.lit("./a/./"), file).alias("relative"))
