"""Text functions against their written rules."""

import pytest
from pyspark.sql import functions as F

from edgewise.functions import sqlrel, templates, urls


@pytest.mark.parametrize(
    "sql,names",
    [
        ("SELECT * FROM a JOIN b ON a.id = b.id", ["a", "b"]),
        ("INSERT INTO logs (id) VALUES (1)", ["logs"]),
        ("TRUNCATE TABLE events", ["events"]),
        ("UPDATE table SET x = 1", ["table"]),
        ("SELECT * FROM a, b, c.d", ["a", "b", "c.d"]),
        ('SELECT * FROM "odd.name"', ["odd%2Ename"]),
        ("SELECT * FROM [dbo].[users]", ["dbo.users"]),
        ("SELECT 1 -- x\nFROM t /* FROM u */", ["t"]),
        ("WITH recent AS (SELECT 1) SELECT * FROM recent; SELECT * FROM recent", ["recent"]),
        ("WITH c AS NOT MATERIALIZED (SELECT * FROM orders) SELECT * FROM c", ["orders"]),
        ("SELECT EXTRACT(YEAR FROM x) FROM orders", ["orders"]),
        ("SELECT (SELECT max(id) FROM users) FROM orders", ["users", "orders"]),
        ("SELECT * FROM e WHERE a IS NOT DISTINCT FROM b", ["e"]),
        ("GRANT SELECT ON t TO u; REVOKE ALL FROM v", []),
        ("", []),
    ],
)
def test_relations(sql, names):
    assert sqlrel.relations(sql).relations == names


def test_relation_counts():
    assert sqlrel.relations("SELECT * FROM series(1, 2) AS s, t").functions == 1
    assert sqlrel.relations("SELECT * FROM %s").placeholders == 1
    assert sqlrel.relations("SELECT * FROM app.%s WHERE a = $1") == ([], 0, 1)
    assert sqlrel.dynamic_channel(" select\n x" + "é" * 100).endswith("...") and sqlrel.dynamic_channel("\x01") == "<dynamic>"


@pytest.mark.parametrize(
    "template,problem",
    [("/a/{}/b", ""), ("/{**}", ""), ("a", "not-rooted"), ("/{**}/x", "catch-all-not-last"), ("/a{", "stray-brace"), ("/x{**}", "catch-all-partial"), ("/{}{}", "multiple-parameters"), ("/%2", "malformed-percent"), ("/%2f", "lowercase-percent-hex"), ("/%41", "encoded-unreserved"), ("/a b", "invalid-character"), ("/" + "a" * 2048, "too-long")],
)
def test_template_grammar(template, problem):
    assert templates.template_problem(template) == problem


def test_literals():
    assert templates.normalize_literal("/a%41%2f é") == "/aA%2F%20%C3%A9"


def test_router_patterns():
    shown = lambda p: [(t, n) for t, n in templates.shapes(p)]
    method, host, parts = templates.parse_servemux("GET example.com/a/{id}/{rest...}")
    assert (method, host, shown(parts)) == ("GET", "example.com", [("/a/{}/{**}", ""), ("/a/{}/", "variant")])
    for bad in ("", "items", "GET /a/../b", "/a{x}", "/{x}/{x...}/y", "/{$}/x", "/{}", "ho{st}/x", "G@T /x", "/{...}"):
        assert templates.parse_servemux(bad) is None
    parts, capped, dynamic = templates.parse_chi("/files*")
    assert templates.shapes(parts, capped) == [("/files/{**}", ""), ("/files", "cap"), ("/files/", "variant")] and not dynamic
    assert templates.parse_chi("/{a}.{b}/x")[2] and templates.parse_chi("/a/*/b") is None
    assert templates.render(templates.parse_gin("/u/:id/*rest")) == "/u/{}/{**}" and templates.join_gin("/v1", "/a/../b/") == "/v1/b/"
    assert templates.render(templates.parse_echo(r"/a\:b/:id")) == "/a:b/{}"
    assert templates.strip_json_keys('json:"a,omitempty" db:"-" xml:"b"') == ["json", "xml"]


def test_urls():
    lit, val = lambda t: ("lit", t), ("val",)
    assert urls.compose_path([lit("/users/"), val, lit("/x?y=1")]) == {"template": "/users/{}/x", "query": True}
    assert urls.compose_path([lit("/users-"), val])["dynamic"]
    assert urls.compose_url([lit("https://u@Example.com:8080/a"), lit("/b")]) == {"anchor": "root", "authority": "example.com:8080", "template": "/a/b", "query": False}
    assert urls.compose_url([val, lit("/a")])["anchor"] == "base" and urls.compose_url([val, lit("a")])["ambiguous"]
    assert urls.mask("/services/T0/abc", "hooks.slack.com") == "/{}/{}/{}" and urls.mask("/k/abcdefgh12345678") == "/k/{}"
    assert urls.mask("/services/T0/abc", "slack.example.com") == "/services/T0/abc" and urls.mask("/k/%61bcdefgh1234567") == "/k/%61bcdefgh1234567"
    hook = lambda u: urls.compose_url([("lit", u)])["template"]
    assert hook("https://hooks.slack.com/services/T00/B00/abcd") == "/{}/{}/{}/{}" and hook("https://discord.com:443/api/webhooks/123456/tok-short?x=1") == "/api/webhooks/{}/{}"
    assert hook("https://discord.com/api/channels/1") == "/api/channels/1"
    assert urls.join_path("http://h/a/", "..", "b?c/") == "http://h/b%3Fc/" and urls.join_path(None, "..") is None
    assert urls.posix_join("/a", "", "../b/") == "/b" and urls.posix_join() == ""
    assert urls.resolve("http://h/a/b", "../c") == "http://h/c" and urls.resolve(None, "") is None
    assert urls.slash_join("http://h/", "x", trims=True) == "http://h/x" and urls.slash_join("b", "http://o/p") == "http://o/p"


def test_portable_files_and_tag_columns(spark):
    from edgewise.functions.ids import portable_file
    from edgewise.functions.sqlrel import tag_column

    files = {"/r/a/x.go": "a/x.go", "/other/x.go": "x.go", "../up/x.go": "x.go", "a/../../x.go": "x.go", "./a//x.go": "a/x.go", r"C:\m\x.go": "x.go", "/r2/x.go": "x.go", "x.go": "x.go"}
    df = spark.createDataFrame([(k,) for k in files], "f string")
    assert {r.f: r.p for r in df.select("f", portable_file(F.col("f"), "/r").alias("p")).collect()} == files
    tags = {'db:"a,x"': "a", 'json:"db" sql:"b"': "b", 'gorm:"size:1;Column:C"': "C", 'db:"-"': None, 'xdb:"q"': None, 'json:"db:\\"z\\"" db:"w"': "w", 'db:"" gorm:"column:g"': "g", "db:bad": None}
    df = spark.createDataFrame([(k,) for k in tags], "t string")
    assert {r.t: r.c for r in df.select("t", tag_column(F.col("t")).alias("c")).collect()} == tags
