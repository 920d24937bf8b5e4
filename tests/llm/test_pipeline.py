"""The pipeline's stages on a small corpus, each held against what it must decide."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from edgewise.llm import near_copies
from edgewise.session import stage

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    kept = [docs]
    for _, f in P.STAGES[:-1]:
        out = stage(f(spark, kept[-1], SF), "test")
        assert out.columns == P.COLUMNS
        kept.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    good = {i for i, q in labels.items() if q == 1}
    bad = {i for i, q in labels.items() if q == 0}
    assert len(good & ids[1]) >= 0.98 * len(good) and len(bad & ids[1]) <= 0.05 * len(bad)
    assert ids[2] == ids[1] and kept[2].where("n_chars <> length(text)").count() == 0
    rows = {r.doc_id: r.text for r in kept[2].select("doc_id", "text").collect()}
    group = by_jaccard(rows)
    assert ids[3] == {i for i in rows if group(i) == i}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in kept[3].select("doc_id", "text").collect()}
    leaks = {i for i, t in texts.items() if any(x in t for x in items)}
    assert leaks and not leaks & ids[4] and len(ids[3] - ids[4] - leaks) <= 0.02 * len(ids[3])
    pieces = P.STAGES[-1][1](spark, kept[-1], SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert pieces.count() == len(ids[4]) and pieces.where("n <> t").count() == 0


def test_run_returns_the_last_stage(spark):
    assert P.run(spark, "/root/testdata/sf0.001").columns[:3] == ["doc_id", "start", "length"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def by_jaccard(texts, width=5):
    """The smallest id of each group of texts {id: text} that exact similarities of 0.8 connect."""
    sets, where, group = {}, {}, {i: i for i in texts}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}
        for x in sets[i]:
            where.setdefault(x, []).append(i)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in sets.items():
        for j, n in Counter(j for y in x for j in where[y] if j < i).items():
            if n >= 0.8 * (len(x) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return root


def test_near_stage_keeps_every_text_of_its_own(spark):
    one, two, three, four = (" ".join(f"{w}{k}" for k in range(40)) for w in "abcd")
    rows = [(2, one), (1, one), (None, two), (None, two), (None, three), (3, None), (None, ""), (7, one), (7, four), (7, four), (None, four)]
    out = P.near_stage(spark, documents(spark, rows), SF)
    assert out.columns == P.COLUMNS
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, two), (0, three), (1, one), (3, ""), (7, four)]


def test_leak_stage_goes_by_rows(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    filler = " ".join(f"word{k}" for k in range(50))
    rows = [(None, f"{filler} {item}"), (None, filler), (7, item), (7, f"other {filler}"), (8, None), (9, "")]
    docs = documents(spark, rows).union(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 100, *P.COLUMNS[1:]))
    out = P.leak_stage(spark, docs, SF).where("doc_id is null or doc_id < 100")
    assert sorted(((r.doc_id or 0, r.text or "") for r in out.collect())) == [(0, filler), (7, f"other {filler}"), (8, ""), (9, "")]


def test_stages_on_empty_and_odd_tables(spark):
    odd = [(None, None), (1, ""), (1, ""), (2, " \n"), (3, "x " * 40_000), (None, "no id")]
    for rows in ([], odd):
        docs = documents(spark, rows).withColumns({"score": F.lit("x"), "_row": F.lit("y"), "node": F.lit("z"), "_node": F.lit(1)})
        for name, f in P.STAGES:
            out = f(spark, docs, "/root/testdata/sf0.001")
            assert name == "packing" or out.columns == P.COLUMNS
            assert (out.count() == 0) == (not rows or name == "quality classifier" and out.count() == 0)


def edited(n, words=300, tag="v", at=10):
    """Copies of a text, each with some words of its own in a row."""
    return [" ".join(f"{tag}{k}" if not j <= k < j + at else f"u{tag}{j}" for k in range(words)) for j in range(n)]


def test_near_stage_equals_brute_force_jaccard(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = [f"w{k}" for k in range(200)]
    rows += [(10**6 + n, " ".join([*words[:50], *(f"x{n}" for _ in range(n)), *words[50 + n :]])) for n in (0, 10, 15, 30, 60)]
    # Large groups of copies, near each other and at the limit, and texts that only share a passage.
    rows += [(2 * 10**6 + n, t) for n, t in enumerate(edited(60))]
    rows += [(3 * 10**6 + n, t) for n, t in enumerate(edited(60, tag="m", at=28))]
    rows += [(4 * 10**6 + n, " ".join([*(f"p{k}" for k in range(100)), *(f"q{n}x{k}" for k in range(30 + n % 40))])) for n in range(80)]
    root = by_jaccard(dict(rows))
    got = {r.doc_id for r in P.near_stage(spark, documents(spark, rows), SF).select("doc_id").collect()}
    assert got == {i for i, _ in rows if root(i) == i}
    assert 10**6 + 10 not in got and 10**6 + 15 not in got and 10**6 + 60 in got


def test_pairs_left_apart_are_compared_in_place_or_by_a_join(spark, monkeypatch):
    # Two families meet in every band, the first member of a group is of neither.
    texts = [*edited(12, tag="m", at=28), *edited(12, tag="m", at=30)]
    docs = documents(spark, list(enumerate(texts)))
    root = by_jaccard(dict(enumerate(texts)))
    for held in (near_copies.HELD_BYTES, 0):
        monkeypatch.setattr(near_copies, "HELD_BYTES", held)
        got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
        assert got == {i: root(i) for i in range(len(texts))}
