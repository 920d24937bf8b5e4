"""Registry of the graph queries and their DuckDB counterparts, over the part graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgewise import graph as G
from edgewise.functions.ids import canonical_id, member_owner, short_name
from edgewise.operators import cycles, diff, queries, rules, traversal
from edgewise.operators.reach import discover, reachable
from edgewise.plans.project import SQL, lines, part_graph
from edgewise.session import read_table, stage

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, on_graph: bool = True):
    """Register a query under its function's name; ``sql`` goes behind the graph's common tables, as
    further ones if it starts with a plus."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql if not on_graph else f"WITH RECURSIVE {SQL.strip()}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}"
        return f

    return add


def _text(c: str):
    return F.array_join(F.col(c), ",").alias(c)


def _root(g) -> str:
    """The stock with the most dependencies, of several the first."""
    return _tops(g, 1)[0]


def _tops(g, n: int) -> list[str]:
    """The ``n`` stocks with the most dependencies, of equal ones the first."""
    pairs = G.dependencies(g).where(_stock("src")).select("src", "dst").distinct()
    return [r.src for r in pairs.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(n).collect()]


def _part(c: str = "id"):
    return F.split_part(c, F.lit("/"), F.lit(2)).cast("int")


def _stock(c):
    return F.col(c).startswith("part/")


def _roots(g):
    """The stocks of every 97th part: a choice of roots is an input of the query."""
    return g.vertices.where(F.when(_stock("id"), _part()) % 97 == 0).select("id")


ROOTS_SQL = "roots AS (SELECT id FROM vertices WHERE CASE WHEN id LIKE 'part/%' THEN CAST(split_part(id, '/', 2) AS INT) END % 97 = 0)"
# Breadth-first: a vertex is kept with the depth at which it is first found.
LEVELS = """levels(id, depth) USING KEY (id) AS (SELECT id, 0 FROM {start}
  UNION SELECT d.{to}, w.depth + 1 FROM levels w JOIN deps d ON d.{fro} = w.id LEFT JOIN recurring.levels r ON r.id = d.{to} WHERE r.id IS NULL AND w.depth < {most})"""


def _levels(start: str, forward: bool, most: int) -> str:
    return LEVELS.format(start=start, to="dst" if forward else "src", fro="src" if forward else "dst", most=most)


@query("SELECT src, dst, kind, candidate, n AS n_positions FROM edges")
def normalize_edges(spark, sf_dir):
    e = G.normalize(part_graph(spark, sf_dir)).edges
    return e.select("src", "dst", "kind", "candidate", F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_positions"))


@query("SELECT e.src, e.dst, e.kind FROM edges e JOIN vertices a ON a.id = e.src JOIN vertices b ON b.id = e.dst WHERE e.kind IN ('call', 'references') AND a.kind <> 'package' AND b.kind <> 'package'")
def level_view(spark, sf_dir):
    return G.view(part_graph(spark, sf_dir), "symbol").edges.select("src", "dst", "kind")


@query("SELECT src, dst, kind FROM edges WHERE kind = 'import'")
def package_view(spark, sf_dir):
    return G.view(part_graph(spark, sf_dir), "package").edges.select("src", "dst", "kind")


def _neighbor_sql(depth: int) -> str:
    one = lambda name, fro, to: f"""{name}_w AS (SELECT id, 0 AS depth FROM root UNION SELECT d.{to}, w.depth + 1 FROM {name}_w w JOIN deps d ON d.{fro} = w.id WHERE w.depth < {depth}),
{name} AS (SELECT id, min(depth) AS depth FROM {name}_w GROUP BY id)"""  # noqa: E731
    return f"+ {one('fwd', 'src', 'dst')}, {one('bwd', 'dst', 'src')} SELECT 'dependsOn' AS direction, id, depth FROM fwd WHERE depth > 0 UNION ALL SELECT 'dependedBy', id, depth FROM bwd WHERE depth > 0"


@query(_neighbor_sql(1))
def neighbors_d1(spark, sf_dir):
    g = part_graph(spark, sf_dir, positions=False)
    return queries.query(g, _root(g), 1).select("direction", "id", "depth")


@query(_neighbor_sql(3))
def neighbors_d3(spark, sf_dir):
    g = part_graph(spark, sf_dir, positions=False)
    return queries.query(g, _root(g), 3).select("direction", "id", "depth")


@query(f"+ kinds AS (SELECT dst, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM edges WHERE src IN (SELECT id FROM root) AND kind <> 'contains' AND dst <> src GROUP BY dst) SELECT dst AS id, kinds FROM kinds")
def neighbor_kinds(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    return queries.query(g, _root(g), 1).where("direction = 'dependsOn'").select("id", _text("kinds"))


_REACH = "+ reached AS (SELECT id FROM root UNION SELECT d.dst FROM reached r JOIN deps d ON d.src = r.id) SELECT id FROM reached"


def _reach_set(spark, sf_dir):
    g = part_graph(spark, sf_dir, positions=False)
    return reachable(G.dependencies(g), queries.keyed(g, [_root(g)]).select("id"))


@query(_REACH)
def reach_set(spark, sf_dir):
    return _reach_set(spark, sf_dir)


@query(_REACH)
def reach_set_distributed(spark, sf_dir):
    return _reach_set(spark, sf_dir)


@query(f"+ {ROOTS_SQL}, reached AS (SELECT id FROM roots UNION SELECT d.dst FROM reached r JOIN deps d ON d.src = r.id) SELECT id, kind, exported FROM vertices WHERE kind <> 'package' AND id NOT IN (SELECT id FROM reached)")
def dead(spark, sf_dir):
    g = part_graph(spark, sf_dir, positions=False)
    return queries.dead(g, reachable(queries.reach_pairs(g), _roots(g))).select("id", "kind", "exported")


@query(f"""+ {ROOTS_SQL}, greach AS (SELECT id FROM roots UNION SELECT d.dst FROM greach r JOIN deps d ON d.src = r.id),
calls AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'call'), rta AS (SELECT id FROM roots UNION SELECT c.dst FROM rta r JOIN calls c ON c.src = r.id)
SELECT id, CASE WHEN kind IN ('func', 'method') THEN 'rta' ELSE 'graph' END AS by FROM vertices WHERE kind <> 'package'
  AND CASE WHEN kind IN ('func', 'method') THEN id NOT IN (SELECT id FROM rta) ELSE id NOT IN (SELECT id FROM greach) END""")
def dead_rta(spark, sf_dir):
    g = part_graph(spark, sf_dir, positions=False)
    roots = _roots(g)
    rta = reachable(g.edges.where("kind = 'call'"), roots)
    out = queries.dead_rta(g, reachable(queries.reach_pairs(g), roots), rta)
    return out.select("id", F.when(F.col("reason").contains("rapid"), "rta").otherwise("graph").alias("by"))


_IMPACT = f"""+ {_levels("root", False, 300)}
SELECT e.src AS id, w.depth + 1 AS depth, string_agg(DISTINCT e.kind, ',' ORDER BY e.kind) AS kinds
FROM levels w JOIN edges e ON e.dst = w.id AND e.kind <> 'contains' JOIN levels l ON l.id = e.src AND l.depth = w.depth + 1 GROUP BY ALL"""


def _impact(spark, sf_dir):
    g = part_graph(spark, sf_dir, positions=False)
    return queries.impact(g, [_root(g)]).select("id", "depth", _text("kinds"))


@query(_IMPACT)
def impact_depth(spark, sf_dir):
    return _impact(spark, sf_dir)


@query(_IMPACT)
def impact_distributed(spark, sf_dir):
    return _impact(spark, sf_dir)


@query(f"+ {_levels('root', True, 300)} SELECT id, depth FROM levels")
def path_length(spark, sf_dir):
    g = part_graph(spark, sf_dir, positions=False)
    return discover(G.dependencies(g), queries.keyed(g, [_root(g)]), ranked=False, parents=False).select("id", "depth")


# Discovery order: by depth, then by the parent's place and the id; so the first path is the one whose ids, from the
# root on, are smallest. Written as a list of ids a path, kept for the first discoverer of each vertex.
@query(f"""+ {_levels('root', True, 300)}, goal AS (SELECT max(id) AS id FROM levels WHERE depth = (SELECT max(depth) FROM levels)),
back AS (SELECT id, depth FROM levels WHERE id IN (SELECT id FROM goal) UNION SELECT l.id, l.depth FROM back b JOIN deps d ON d.dst = b.id JOIN levels l ON l.id = d.src AND l.depth = b.depth - 1),
walked AS (SELECT id, depth, [id] AS path FROM root, (SELECT 0 AS depth) UNION ALL
  SELECT id, depth, path FROM (SELECT b.id, b.depth, list_append(w.path, b.id) AS path, row_number() OVER (PARTITION BY b.id, b.depth ORDER BY w.path) AS k
    FROM walked w JOIN deps d ON d.src = w.id JOIN back b ON b.id = d.dst AND b.depth = w.depth + 1) WHERE k = 1)
SELECT i - 1 AS step, path[i] AS id FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM walked WHERE id IN (SELECT id FROM goal))""")
def shortest_path(spark, sf_dir):
    """The path to the farthest vertex."""
    g = part_graph(spark, sf_dir, positions=False)
    root = _root(g)
    far = discover(G.dependencies(g), queries.keyed(g, [root]), ranked=False, parents=False).orderBy(F.desc("depth"), F.desc("id")).first()
    return queries.path(g, root, far.id).select(F.col("step").cast("long").alias("step"), "id")


_SHARED_SQL = """tops AS (SELECT src AS id, row_number() OVER (ORDER BY count(*) DESC, src) - 1 AS k FROM deps WHERE src LIKE 'part/%' GROUP BY src QUALIFY k < 3),
reached AS (SELECT k, id FROM tops UNION SELECT r.k, d.dst FROM reached r JOIN deps d ON d.src = r.id)"""


@query(f"+ {_SHARED_SQL} SELECT id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS roots, count(*) = 3 AS shared FROM reached GROUP BY id")
def shared_dependencies(spark, sf_dir):
    """Of the three stocks with the most dependencies."""
    g = part_graph(spark, sf_dir, positions=False)
    out = queries.shared(g, _tops(g, 3))
    return out.select("id", _text("roots"), (F.col("n") == 3).alias("shared"))


_SCC = """closure AS (SELECT src, dst FROM imports UNION SELECT c.src, p.dst FROM closure c JOIN imports p ON p.src = c.dst),
mutual AS (SELECT a.src AS id, a.dst AS other FROM closure a JOIN closure b ON a.src = b.dst AND a.dst = b.src),
members AS (SELECT id, min(other) AS component FROM mutual GROUP BY id)"""


@query(f"+ {_SCC} SELECT component, id FROM members")
def scc_members(spark, sf_dir):
    return cycles.cycles(G.view(part_graph(spark, sf_dir), "package")).select("component", "id")


@query(f"+ {_SCC} SELECT component, id FROM members")
def scc_distributed(spark, sf_dir):
    return cycles.cycles(G.view(part_graph(spark, sf_dir), "package")).select("component", "id")


@query(f"+ {_SCC} SELECT a.component, i.src, i.dst FROM imports i JOIN members a ON a.id = i.src JOIN members b ON b.id = i.dst AND a.component = b.component")
def scc_evidence(spark, sf_dir):
    g = G.view(part_graph(spark, sf_dir), "package")
    return cycles.evidence(g, cycles.cycles(g)).select("component", "src", "dst")


@query()
def scc_symbols(spark, sf_dir):
    """Cycles of all stocks; their closure is too large for SQL, tests hold the operator against brute force."""
    return cycles.cycles(part_graph(spark, sf_dir, positions=False)).select("component", "id")


RULES = rules.Rules(
    components={"first": ["brand/Brand#1*"], "second": ["brand/Brand#2*", "brand/Brand#3*"], "exact": ["brand/Brand#11"], "dozen": ["brand/Brand#12"], "pair": ["brand/Brand#31", "brand/Brand#32"], "rest": ["brand/**"]},
    deps={"first": ["rest"], "second": ["first"], "rest": ["second"]},
    deny={"rest": [{"to": "second", "reason": "no way back"}]},
    visibleTo={"rest": ["second"]},
    signature={"first": ["second"]},
    fileRules=[{"name": "low", "from": "orders/1*", "to": "second", "reason": "low orders"}],
    forbidden=[{"from": "first", "to": "rest"}],
    independent=["second", "rest"],
    limits=[{"component": "second", "maxIn": 1, "maxOut": 0}, {"component": "first", "maxIn": 0, "maxOut": 9}],
    stability=True,
)
_COMP = """every_comp AS (SELECT id, CASE WHEN id = 'brand/Brand#11' THEN 'exact' WHEN id = 'brand/Brand#12' THEN 'dozen' WHEN id IN ('brand/Brand#31', 'brand/Brand#32') THEN 'pair'
  WHEN regexp_matches(id, '^brand/Brand#1[^/]*$') THEN 'first' WHEN regexp_matches(id, '^brand/Brand#[23][^/]*$') THEN 'second'
  WHEN id LIKE 'brand/%' THEN 'rest' END AS component FROM vertices WHERE kind = 'package'),
comp AS (SELECT * FROM every_comp WHERE component IS NOT NULL),
ranked AS (SELECT DISTINCT a.component AS fc, b.component AS tc FROM imports i JOIN comp a ON a.id = i.src JOIN comp b ON b.id = i.dst WHERE a.component <> b.component),
units AS (SELECT component AS unit, (SELECT count(*) FROM ranked WHERE tc = component) AS ca, (SELECT count(*) FROM ranked WHERE fc = component) AS ce FROM (SELECT DISTINCT component FROM comp))"""


@query(f"+ {_COMP} SELECT id, component FROM every_comp")
def mapping(spark, sf_dir):
    return rules.mapping(part_graph(spark, sf_dir), RULES).select("id", "component")


@query(f"""+ {_COMP}, checked AS (
  SELECT i.src, i.dst, 'import' AS kind, a.component AS fc, b.component AS tc FROM imports i JOIN comp a ON a.id = i.src JOIN comp b ON b.id = i.dst
  UNION ALL SELECT e.src, e.dst, 'signature', a.component, b.component FROM edges e JOIN vertices s ON s.id = e.src AND s.exported JOIN vertices t ON t.id = e.dst
    JOIN comp a ON a.id = s.package JOIN comp b ON b.id = t.package WHERE e.kind = 'signature')
SELECT src, dst, kind, rule FROM (SELECT src, dst, kind, CASE WHEN fc = tc THEN NULL WHEN fc = 'rest' AND tc = 'second' THEN 'deny'
  WHEN kind = 'signature' AND fc = 'first' AND tc <> 'second' THEN 'signature'
  WHEN NOT ((fc = 'first' AND tc = 'rest') OR (fc = 'second' AND tc = 'first') OR (fc = 'rest' AND tc = 'second')) THEN 'allow'
  WHEN tc = 'rest' AND fc <> 'second' THEN 'visibleTo' END AS rule FROM checked) WHERE rule IS NOT NULL""")
def rules_precedence(spark, sf_dir):
    return rules.edge_violations(part_graph(spark, sf_dir), RULES).select(F.col("from").alias("src"), F.col("to").alias("dst"), "kind", "rule")


@query(f"+ {_COMP} SELECT unit, 'maxOut' AS name, ce AS n FROM units WHERE unit = 'second' AND ce > 0 UNION ALL SELECT unit, 'maxIn', ca FROM units WHERE (unit = 'second' AND ca > 1) OR (unit = 'first' AND ca > 0) UNION ALL SELECT unit, 'maxOut', ce FROM units WHERE unit = 'first' AND ce > 9")
def limits(spark, sf_dir):
    v = rules.limit_violations(part_graph(spark, sf_dir), RULES)
    return v.select(F.concat("fromComponent", "toComponent").alias("unit"), "name", F.regexp_extract("reason", r"(\d+) components", 1).cast("long").alias("n"))


@query(f"+ {_COMP}, inst AS (SELECT unit, ce / (ca + ce) AS i FROM units WHERE ca + ce > 0) SELECT i.src, i.dst FROM imports i JOIN comp a ON a.id = i.src JOIN comp b ON b.id = i.dst JOIN inst x ON x.unit = a.component JOIN inst y ON y.unit = b.component WHERE a.component <> b.component AND y.i > x.i")
def stability(spark, sf_dir):
    return rules.stability_violations(part_graph(spark, sf_dir), RULES).select(F.col("from").alias("src"), F.col("to").alias("dst"))


@query(f"""+ {_COMP}, vc AS (SELECT v.id, c.component FROM vertices v JOIN comp c ON c.id = coalesce(v.package, v.id)),
wanted AS (SELECT * FROM (VALUES ('forbidden', 'first', 'rest'), ('independence', 'second', 'rest'), ('independence', 'rest', 'second')) t(rule, a, b)),
wreach AS (SELECT w.a, v.id FROM wanted w JOIN vc v ON v.component = w.a UNION SELECT r.a, d.dst FROM wreach r JOIN deps d ON d.src = r.id)
SELECT DISTINCT w.rule, w.a AS from_component, w.b AS to_component FROM wanted w JOIN wreach r ON r.a = w.a JOIN vc v ON v.id = r.id AND v.component = w.b""")
def forbidden_pairs(spark, sf_dir):
    v = rules.reach_violations(part_graph(spark, sf_dir, positions=False), RULES)
    return v.select("rule", F.col("fromComponent").alias("from_component"), F.col("toComponent").alias("to_component"))


@query(f"""+ {_COMP}, pos AS (SELECT DISTINCT src, dst, file, line FROM raw WHERE kind = 'call')
SELECT p.src, p.dst, p.file, p.line FROM pos p JOIN vertices s ON s.id = p.src JOIN vertices t ON t.id = p.dst JOIN comp c ON c.id = t.package AND c.component = 'second' WHERE regexp_matches(p.file, '^orders/1[^/]*$')""")
def file_scope(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    # Calls between parts stand as imports between their brands, positions kept.
    of = g.vertices.where("kind <> 'package'").select("id", "package")
    calls = g.edges.where("kind = 'call'").join(of.select(F.col("id").alias("src"), F.col("package").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("package").alias("b")), "dst")
    at = calls.select(F.col("a").alias("src"), F.concat("b").alias("dst"), F.lit("import").alias("kind"), F.transform("positions", lambda p: F.struct(p["file"].alias("file"), p["line"].alias("line"), p["column"].alias("column"))).alias("positions"), "candidate", F.col("src").alias("s"), F.col("dst").alias("d"))
    v, _ = rules.file_violations(g.with_(edges=at.select("src", "dst", "kind", "positions", "candidate")), RULES)
    marked = at.select("src", "dst", "s", "d", F.explode("positions").alias("position"))
    return v.select(F.col("from").alias("src"), F.col("to").alias("dst"), "position").distinct().join(marked, ["src", "dst", "position"]).select(F.col("s").alias("src"), F.col("d").alias("dst"), F.col("position.file").alias("file"), F.col("position.line").alias("line"))


@query("SELECT id FROM vertices WHERE kind = 'package' AND id NOT IN (SELECT dst FROM imports)")
def orphans(spark, sf_dir):
    return rules.orphans(part_graph(spark, sf_dir))


@query("""+ names AS (SELECT id FROM vertices WHERE kind = 'package'), d AS (SELECT id, (SELECT count(DISTINCT src) FROM imports WHERE dst = id) AS ca, (SELECT count(DISTINCT dst) FROM imports WHERE src = id) AS ce FROM names),
t AS (SELECT package, sum(CASE WHEN interface THEN 1 ELSE 0 END) / count(*) AS a FROM vertices WHERE kind = 'type' GROUP BY package)
SELECT d.id AS name, ca, ce, round(CASE WHEN ca + ce > 0 THEN ce / (ca + ce) END * 1000) / 1000 AS instability, round(a * 1000) / 1000 AS abstractness,
  round(abs(a + CASE WHEN ca + ce > 0 THEN ce / (ca + ce) END - 1) * 1000) / 1000 AS distance FROM d LEFT JOIN t ON t.package = d.id""")
def metrics(spark, sf_dir):
    return rules.metrics(part_graph(spark, sf_dir)).drop("packages")


@query(f"+ {_COMP} SELECT name, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce FROM (VALUES ('first'), ('second'), ('exact'), ('dozen'), ('pair'), ('rest')) t(name) LEFT JOIN units ON unit = name")
def component_degrees(spark, sf_dir):
    return rules.metrics(part_graph(spark, sf_dir), RULES).select("name", "ca", "ce")


_CUT = "TIMESTAMP '1995-06-17'"


def _two(spark, sf_dir):
    cut, raw = F.expr(_CUT), lines(spark, sf_dir)
    return part_graph(spark, sf_dir, F.col("shipped") < cut, raw), part_graph(spark, sf_dir, F.col("shipped") >= cut, raw)


_SIDES = f"""sides AS (SELECT DISTINCT src, dst, kind, shipped < {_CUT} AS old FROM raw),
side_calls AS (SELECT src_package AS src, dst_package AS dst, shipped < {_CUT} AS old, count(*) AS n FROM raw WHERE kind = 'call' AND src_package <> dst_package GROUP BY ALL),
side_imports AS (SELECT x.src, x.dst, 'import' AS kind, x.old FROM side_calls x LEFT JOIN side_calls y ON y.src = x.dst AND y.dst = x.src AND y.old = x.old WHERE x.n >= coalesce(y.n, 0)
  UNION ALL SELECT DISTINCT 'segment/' || c_mktsegment, l.src_package, 'import', l.shipped < {_CUT} FROM lines l JOIN orders ON o_orderkey = l.ord JOIN customer ON c_custkey = o_custkey),
all_sides AS (SELECT * FROM sides UNION ALL SELECT * FROM side_imports)"""


@query(f"+ {_SIDES}, o AS (SELECT src, dst, kind FROM all_sides WHERE old), n AS (SELECT src, dst, kind FROM all_sides WHERE NOT old) SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)")
def edge_diff(spark, sf_dir):
    return diff.edge_diff(*_two(spark, sf_dir))


@query(f"""+ {_SIDES}, sig AS (SELECT s.src, s.dst, s.old FROM sides s JOIN vertices v ON v.id = s.src AND v.exported WHERE s.kind = 'signature'),
d AS (SELECT src, dst, 'removed' AS c FROM (SELECT src, dst FROM sig WHERE old EXCEPT SELECT src, dst FROM sig WHERE NOT old) UNION ALL SELECT src, dst, 'added' FROM (SELECT src, dst FROM sig WHERE NOT old EXCEPT SELECT src, dst FROM sig WHERE old))
SELECT src AS id, coalesce(string_agg(dst, ',' ORDER BY dst) FILTER (c = 'added'), '') AS added, coalesce(string_agg(dst, ',' ORDER BY dst) FILTER (c = 'removed'), '') AS removed FROM d GROUP BY src""")
def signature_diff(spark, sf_dir):
    return diff.signature_diff(*_two(spark, sf_dir)).select("id", _text("added"), _text("removed"))


@query("SELECT id, CASE WHEN TRY_CAST(split_part(id, '/', 2) AS INT) % 10 = 3 THEN 'removed' ELSE 'added' END AS change FROM vertices WHERE kind <> 'package' AND TRY_CAST(split_part(id, '/', 2) AS INT) % 10 IN (3, 4)")
def vertex_diff(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    n = F.when(_stock("id"), _part()) % 10
    side = lambda k: g.with_(vertices=g.vertices.where(F.coalesce(n != k, F.lit(True))))
    return diff.vertex_diff(side(4), side(3))


@query("""+ items AS (SELECT kind || ':' || CASE WHEN src LIKE 'part/%' THEN split_part(src, '/', 2)::INT % 50 END AS key, row_number() OVER (PARTITION BY kind, CASE WHEN src LIKE 'part/%' THEN split_part(src, '/', 2)::INT % 50 END ORDER BY src, dst) AS rn FROM edges WHERE kind <> 'contains' AND kind <> 'import' AND candidate),
base AS (SELECT kind || ':' || CASE WHEN src LIKE 'part/%' THEN split_part(src, '/', 2)::INT % 50 END AS key, row_number() OVER (PARTITION BY kind, CASE WHEN src LIKE 'part/%' THEN split_part(src, '/', 2)::INT % 50 END ORDER BY src, dst) AS rn FROM edges WHERE kind = 'call' AND NOT candidate),
ni AS (SELECT key, count(*) AS n FROM items GROUP BY key), nb AS (SELECT key, count(*) AS n FROM base GROUP BY key)
SELECT key, state, count(*) AS n FROM (SELECT i.key, CASE WHEN rn <= coalesce(nb.n, 0) THEN 'baselined' ELSE 'fresh' END AS state FROM items i LEFT JOIN nb USING (key)
UNION ALL SELECT b.key, 'stale' FROM base b JOIN nb USING (key) LEFT JOIN ni USING (key) WHERE rn <= nb.n - coalesce(ni.n, 0)) GROUP BY ALL""")
def baseline_split(spark, sf_dir):
    e = part_graph(spark, sf_dir).edges
    key = F.concat_ws(":", "kind", (F.when(_stock("src"), _part("src")) % 50).cast("string"))
    rows = lambda c: e.where(c).select(key.alias("key"), F.concat_ws(">", "src", "dst").alias("ord"))
    out = diff.split_baseline(rows("kind not in ('contains', 'import') and candidate"), rows("kind = 'call' and not candidate"))
    return out.groupBy("key", "state").agg(F.count("*").alias("n"))


def _placed(spark, sf_dir):
    """The graph with each stock declared in the first order file that mentions it, and the files of one day's orders."""
    g = part_graph(spark, sf_dir)
    first = g.edges.where("positions is not null").groupBy(F.col("src").alias("id")).agg(F.min(F.array_min("positions")).alias("p"))
    v = g.vertices.drop("position").join(first, "id", "left")
    at = F.when(F.col("p").isNotNull(), F.struct(F.concat("p.file", F.lit(".go")).alias("file"), F.col("p.line").alias("line"), F.lit(0).alias("column")))
    v = v.withColumn("position", at).select(*G.VERTEX.names)
    o = read_table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    files = o.where(F.col("day") == o.agg(F.max("day")).first()[0]).select(F.concat(F.lit("orders/"), "o_orderkey", F.lit(".go")).alias("file"))
    return g.with_(vertices=v), files


_PLACED_SQL = """files AS (SELECT 'orders/' || o_orderkey || '.go' AS file FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)),
placed AS (SELECT src AS id, min((file, line))[1] || '.go' AS file FROM raw GROUP BY src), seeds AS (SELECT DISTINCT id FROM placed JOIN files USING (file)),
spots AS (SELECT DISTINCT 'orders' AS dir, v.package AS id FROM placed p JOIN vertices v ON v.id = p.id), picked AS (SELECT id FROM seeds UNION SELECT id FROM spots WHERE (SELECT count(*) FROM files) > 0)"""


@query(f"+ {_PLACED_SQL} SELECT id FROM picked")
def files_to_vertices(spark, sf_dir):
    g, files = _placed(spark, sf_dir)
    return queries.vertices_of_files(g, files)[0]


@query(f"""+ {_PLACED_SQL}, {_levels("picked", False, 300)}, hops AS (SELECT e.src AS id, string_agg(DISTINCT e.dst, ',' ORDER BY e.dst) AS via, string_agg(DISTINCT e.kind, ',' ORDER BY e.kind) AS edges
  FROM edges e JOIN levels a ON a.id = e.dst JOIN levels b ON b.id = e.src AND b.depth = a.depth + 1 WHERE e.kind <> 'contains' GROUP BY e.src)
SELECT l.id, l.depth, coalesce(h.via, '') AS via, coalesce(h.edges, '') AS edges FROM levels l LEFT JOIN hops h USING (id)""")
def change_candidates(spark, sf_dir):
    g, files = _placed(spark, sf_dir)
    return queries.change_candidates(g, files).select("id", "depth", _text("via"), _text("edges"))


_MULTI = f"""starts AS (SELECT src AS root, row_number() OVER (ORDER BY count(*) DESC, src) - 1 AS k FROM deps WHERE src LIKE 'part/%' GROUP BY src QUALIFY k < 10),
sure AS (SELECT DISTINCT src, dst FROM edges WHERE kind <> 'contains' AND NOT candidate),
ml(k, id, depth) USING KEY (k, id) AS (SELECT k, root, 0 FROM starts
  UNION SELECT w.k, d.dst, w.depth + 1 FROM ml w JOIN deps d ON d.src = w.id LEFT JOIN recurring.ml r ON r.k = w.k AND r.id = d.dst WHERE r.id IS NULL AND w.depth < 128),
sw(k, id, depth) USING KEY (k, id) AS (SELECT k, root, 0 FROM starts
  UNION SELECT w.k, d.dst, w.depth + 1 FROM sw w JOIN sure d ON d.src = w.id LEFT JOIN recurring.sw r ON r.k = w.k AND r.id = d.dst WHERE r.id IS NULL AND w.depth < 128),
hits AS (SELECT m.k, m.id, m.depth, (m.k, m.id) IN (SELECT (k, id) FROM sw) AS ok FROM ml m JOIN starts s ON s.k = m.k WHERE m.depth >= 1 AND m.id <> s.root),
near AS (SELECT id, min(depth) AS depth, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS roots, bool_and(ok) AS ok, arg_min(k, depth * 1000 + k) AS k FROM hits GROUP BY id),
via AS (SELECT n.id, min(d.src) AS via FROM near n JOIN deps d ON d.dst = n.id JOIN ml m ON m.k = n.k AND m.id = d.src AND m.depth = n.depth - 1 GROUP BY n.id)"""


@query(f"""+ {_MULTI} SELECT n.id, n.depth, v.via, n.roots, (SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM edges e WHERE e.src = v.via AND e.dst = n.id AND kind <> 'contains') AS relationships,
  CASE WHEN n.ok THEN 'direct' ELSE 'candidate' END AS evidence FROM near n JOIN via v USING (id)""")
def multi_root_reach(spark, sf_dir):
    return _multi(spark, sf_dir)


ORACLE_SQL["multi_root_distributed"] = ORACLE_SQL["multi_root_reach"]


def multi_root_distributed(spark, sf_dir):
    return _multi(spark, sf_dir)


QUERIES["multi_root_distributed"] = multi_root_distributed


def _multi(spark, sf_dir):
    """The ten stocks with the most dependencies, to the full depth."""
    g = part_graph(spark, sf_dir, positions=False)
    g = g.with_(meta=G.Meta(dispatchEvidence=True))
    out, _ = traversal.traverse(g, _tops(g, 10), limit=None)
    return out.select("id", "depth", "via", _text("roots"), _text("relationships"), "evidence")


@query("SELECT id, regexp_extract(id, '[^/]*$') AS short, package FROM vertices")
def id_helpers(spark, sf_dir):
    v = part_graph(spark, sf_dir).vertices
    return v.select(canonical_id(F.concat("id", F.lit("#symbol"))).alias("id"), short_name(F.col("id")).alias("short"), F.regexp_replace(member_owner(F.concat("package", F.lit(".(X).f"))), r"\.X$", "").alias("package"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS authority, length(url) AS n FROM pages", on_graph=False)
def url_authority(spark, sf_dir):
    from edgewise.functions import urls

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [urls.compose_url([("lit", u or "")]).get("authority", "") for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string()), b.column(2)], ["page_id", "authority", "n"])

    return read_table(spark, sf_dir, "pages").select("page_id", "url", F.length("url").cast("long").alias("n")).mapInArrow(run, "page_id long, authority string, n long")


@query("SELECT page_id, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS template FROM pages", on_graph=False)
def url_template(spark, sf_dir):
    from edgewise.functions import urls

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [urls.compose_url([("lit", u or "")]).get("template") for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["page_id", "template"])

    return read_table(spark, sf_dir, "pages").select("page_id", "url").mapInArrow(run, "page_id long, template string")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 't' || p_size WHEN 1 THEN 'a' || p_size || ',' || 's.b' || p_size WHEN 2 THEN 'log' ELSE 'o' || p_size END AS relations,
  CASE WHEN p_partkey % 4 = 2 THEN 1 ELSE 0 END AS functions FROM part""", on_graph=False)
def sql_relations(spark, sf_dir):
    from edgewise.functions.sqlrel import relation_facts

    p, n = read_table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    text = (
        F.when(n == 0, F.concat(F.lit("SELECT x -- from y\nFROM t"), "p_size", F.lit(" WHERE a IS DISTINCT FROM b")))
        .when(n == 1, F.concat(F.lit("WITH c AS (SELECT 1) SELECT * FROM c JOIN a"), "p_size", F.lit(", s.\"b"), "p_size", F.lit("\"")))
        .when(n == 2, F.lit("INSERT INTO log SELECT EXTRACT(day FROM d) FROM series(1, 2)"))
        .otherwise(F.concat(F.lit("UPDATE ONLY o"), "p_size", F.lit(" SET a = 'from z'")))
    )
    return relation_facts(p.select("p_partkey", text.alias("text")), "text").select("p_partkey", _text("relations"), "functions")


@query("+ pairs AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'call'), closure AS (SELECT src, dst FROM pairs UNION SELECT c.src, p.dst FROM closure c JOIN pairs p ON p.src = c.dst), mutual AS (SELECT a.src AS id, a.dst AS other FROM closure a JOIN closure b ON a.src = b.dst AND a.dst = b.src) SELECT min(other) AS component, id FROM mutual GROUP BY id")
def scc_calls(spark, sf_dir):
    g = part_graph(spark, sf_dir, positions=False)
    calls = g.edges.where("kind = 'call'").withColumn("candidate", F.lit(False))
    return cycles.cycles(g.with_(edges=calls)).select("component", "id")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value) * 1000) / 1000 AS total FROM events GROUP BY ALL", on_graph=False)
def event_windows(spark, sf_dir):
    from edgewise.streaming.snapshots import event_windows as windows

    out = windows(read_table(spark, sf_dir, "events"))
    return out.select("start", "event_type", "n", (F.round(F.col("total") * 1000) / 1000).alias("total"))
