"""Searches as supersteps: one stage for all levels, numbers that two ids share, and exchanges of every size."""

import random

from pyspark.sql import functions as F

from edgewise.operators import supersteps
from edgewise.operators.reach import _by_levels, discover

PAIRS, ROOTS = "src string, dst string", "key int, id string"


def jobs(spark, f):
    """How many Spark jobs ``f`` takes."""
    group = f"group-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        f()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_jobs_of_a_search_do_not_grow_with_its_levels(spark):
    """impact, path, shared dependencies and change candidates spent a job and more a level."""
    chain = lambda n: spark.createDataFrame([(f"v{k:03d}", f"v{k + 1:03d}") for k in range(n)], PAIRS)
    root = spark.createDataFrame([(7, "v000")], ROOTS)
    for options in (dict(ranked=False, parents=False), dict()):
        short = jobs(spark, lambda: discover(chain(3), root, **options).count())  # noqa: B023
        assert jobs(spark, lambda: discover(chain(60), root, **options).count()) <= short + 2  # noqa: B023
    assert {(r.key, r.id, r.depth) for r in discover(chain(60), root, ranked=False, parents=False).collect()} == {(7, f"v{k:03d}", k) for k in range(61)}


def test_ids_that_share_a_number_are_told_apart(spark, monkeypatch):
    whole = supersteps.number
    monkeypatch.setattr(supersteps, "number", lambda c, salt=0: F.length(c).cast("long") if salt == 0 else whole(c, salt))
    pairs = spark.createDataFrame([("a", "b"), ("b", "cc"), ("x", "y")], PAIRS)
    found = discover(pairs, spark.createDataFrame([(0, "a")], ROOTS), ranked=False, parents=False)
    assert {(r.id, r.depth) for r in found.collect()} == {("a", 0), ("b", 1), ("cc", 2)}


def test_supersteps_equal_the_search_by_levels(spark):
    rng = random.Random(3)
    pairs = [(f"v{rng.randrange(400)}", f"v{rng.randrange(400)}") for _ in range(700)] + [("v1", None), (None, "v2")]
    pairs = spark.createDataFrame(pairs, PAIRS).where("src IS NOT NULL AND dst IS NOT NULL")
    roots = spark.createDataFrame([(k, f"v{rng.randrange(400)}") for k in (0, 1, 1, 9)] + [(3, "nowhere")], ROOTS)
    rows = lambda df, *c: sorted(tuple(r) for r in df.select("key", "id", "depth", *c).collect())
    for depth in (None, 0, 2):
        want = rows(_by_levels(pairs, roots, depth, False, None), "parent")
        assert rows(discover(pairs, roots, depth, ranked=False), "parent") == want
        assert [r[:3] for r in want] == [r[:3] for r in rows(discover(pairs, roots, depth, ranked=False, parents=False))]
    order = lambda df: [tuple(r) for r in df.orderBy("key", "depth", "rank").select("key", "id", "parent").collect()]
    assert order(discover(pairs, roots)) == order(_by_levels(pairs, roots, None, True, None))


def test_the_jobs_of_a_traversal_do_not_grow_with_its_levels(spark):
    from edgewise import graph as G
    from edgewise.operators import traversal

    def doc(n):
        edges = [(f"v{k:03d}", f"v{k + 1:03d}", "call", k == 1) for k in range(n)]
        return G.from_rows(spark, [{"id": x, "kind": "func"} for x in {x for e in edges for x in e[:2]}], edges, dispatchEvidence=True)

    short = jobs(spark, lambda: traversal.traverse(doc(3), ["v000", "v001"], limit=None))
    assert jobs(spark, lambda: traversal.traverse(doc(40), ["v000", "v001"], limit=None)) <= short + 3
    out, reasons = traversal.traverse(doc(40), ["v000", "v001"], limit=None)
    assert out.count() == 40 and reasons == [] and out.where("evidence = 'candidate'").count() == 39


def test_the_jobs_of_a_component_do_not_grow_with_its_width(spark):
    from edgewise.operators import cycles

    band = lambda n: spark.createDataFrame([p for k in range(n) for p in ((f"v{k:02d}", f"v{k + 1:02d}"), (f"v{k + 1:02d}", f"v{k:02d}"))], PAIRS)
    short = jobs(spark, lambda: cycles.components(band(4)))
    assert jobs(spark, lambda: cycles.components(band(40))) <= short + 6
    assert {tuple(r) for r in cycles.components(band(40)).collect()} == {("v00", f"v{k:02d}") for k in range(41)}
