"""Reach sets over a stream of edges against the search over all of them."""

import random

from edgewise.operators.reach import discover
from edgewise.streaming.growth import grow_reach, reached

ROOTS = [(0, "v00"), (1, "v01"), (1, "v02"), (2, "alone")]


def _run(spark, folder, roots):
    stream = spark.readStream.schema("src string, dst string").option("maxFilesPerTrigger", 1).json(f"{folder}/in")
    grow_reach(stream, roots, f"{folder}/out", f"{folder}/checkpoint", 4).trigger(availableNow=True).start().awaitTermination()
    return [(r.key, r.id) for r in reached(spark, f"{folder}/out").collect()]


def _drop(spark, folder, pairs):
    spark.createDataFrame(pairs, "src string, dst string").coalesce(1).write.mode("append").json(f"{folder}/in")


def test_reach_grows_with_the_edges_and_survives_a_restart(spark, tmp_path):
    rng, roots = random.Random(11), spark.createDataFrame(ROOTS, "key int, id string")
    pairs = list({(f"v{rng.randrange(18):02d}", f"v{rng.randrange(18):02d}") for _ in range(30)})
    rng.shuffle(pairs)
    so_far = []
    for part in (pairs[:12], pairs[12:20] + pairs[:3] + [(None, "v03"), ("v04", None)], pairs[20:]):
        _drop(spark, str(tmp_path), part)
        so_far += [p for p in part if None not in p]
        got = _run(spark, str(tmp_path), roots)  # a query of its own each time: it takes up the checkpoint and the tables
        want = {(r.key, r.id) for r in discover(spark.createDataFrame(so_far, "src string, dst string"), roots, ranked=False).collect()}
        assert len(got) == len(set(got)) and set(got) == want


def test_tables_are_found_again_and_a_batch_may_run_twice(spark, tmp_path):
    from edgewise.streaming import growth

    roots = spark.createDataFrame([(0, "a")], "key int, id string")
    _drop(spark, str(tmp_path), [("a", "b"), ("c", "d")])
    assert set(_run(spark, str(tmp_path), roots)) == {(0, "a"), (0, "b")}
    for name in ("edges", "reached"):  # what another session knows of the tables: nothing
        columns, keys = ("src STRING, dst STRING", "src") if name == "edges" else ("key INT, id STRING", "key, id")
        spark.sql("DROP TABLE " + growth._table(spark, f"{tmp_path}/out/{name}", columns, keys, 4))
    _drop(spark, str(tmp_path), [("b", "c")])
    assert set(_run(spark, str(tmp_path), roots)) == {(0, x) for x in "abcd"}
    latest = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for f in (latest, latest.with_name(f".{latest.name}.crc")):  # as if the driver had been lost before the commit
        if f.exists():
            f.unlink()
    got = _run(spark, str(tmp_path), roots)
    assert sorted(got) == [(0, x) for x in "abcd"]
    assert {r.id: r.batch for r in reached(spark, f"{tmp_path}/out").collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}
