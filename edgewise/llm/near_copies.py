"""Near copies: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

The closest pairs come from the deletion-variant index of :mod:`edgewise.llm.simhash`. At a
similarity of 0.8 fingerprints of 64 bits differ in about ten bits, which no such index
reaches; further candidates share one of BANDS bands of ROWS minima of the shingle hashes. A
pair of similarity 0.8 shares no band with a probability of (1 - 0.8^ROWS)^BANDS, about 3 in a
million. Every link is verified by the exact similarity of the texts.

In a first step each member of a band group is only compared with the group's first one, so
a large group of copies costs a comparison a member. What these links leave apart is
then compared in whole: members of one group that lie in different components, whose
fingerprints differ in at most FAR_BITS (five standard deviations at 0.8) and whose
shingle sets have sizes that allow 0.8. Only members with such a partner carry their
texts to the group, where a pair of components is done with its first link. A group
whose sets exceed HELD_BYTES in a task hands out its pairs instead, to be verified by a join.

Defined cases: null, empty and blank texts are copies of each other; texts of fewer than
``width`` words are one shingle; equal texts (by 64-bit hash) meet before the index;
repeated rows each keep their row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.llm.links import components
from edgewise.llm.simhash import bits_of, near_links, shingle_hashes, shingles
from edgewise.session import release, stage

LEAST = 0.8
BANDS, ROWS, SEED = 32, 5, 17
FAR_BITS = 24
#: Bytes of shingle sets that a task holds for one group.
HELD_BYTES = 256 << 20
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def similarity(one: str | None, two: str | None, width: int) -> float:
    """Jaccard similarity of the shingle sets of two texts; 1 where both are empty."""
    a, b = (set(shingles(x or "", width)) for x in (one, two))
    return len(a & b) / len(a | b) if a or b else 1.0


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of hashes have a similarity of LEAST or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= LEAST * (len(a) + len(b) - both)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band, of the minima of its ROWS permutations."""
    from xxhash import xxh64_intdigest

    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        low = np.minimum(low, (hashes[at : at + 1024, None] * MULTIPLIERS).min(0))
    return np.array([xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def node_of(text: str = "text"):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, node, fp, size, bands) of each row; one narrow pass."""

    def run(batches):
        for batch in batches:
            fps, sizes, keys = [], [], []
            for text in batch.column(2):
                hashes = np.unique(shingle_hashes(text.as_py() or "", width))
                fps.append(bits_of(hashes))
                sizes.append(len(hashes))
                keys.append(band_keys(hashes))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), bands], ["doc_id", "node", "fp", "size", "bands"])

    return docs.select("doc_id", node_of().alias("node"), "text").mapInArrow(run, "doc_id long, node long, fp long, size long, bands array<long>")


def by_key(batches) -> Iterator[np.ndarray]:
    """Whole groups, several at a time, from batches of long columns that are sorted by the first one."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy() for c in batch.columns], 1))
        if held[0][0, 0] == held[-1][-1, 0]:
            continue
        rows = np.concatenate(held)
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        yield np.ascontiguousarray(rows[:last])
        held = [rows[last:]]
    if held:
        yield np.concatenate(held)


def starts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of equal keys."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return starts, np.diff(np.append(starts, len(keys)))


def close(fp, fps, size, sizes) -> np.ndarray:
    """Which fingerprints and set sizes allow a similarity of LEAST."""
    return (np.bitwise_count((fp ^ fps).view(np.uint64)) <= FAR_BITS) & (np.minimum(size, sizes) >= LEAST * np.maximum(size, sizes))


def banded(nodes: DataFrame, *columns: str) -> DataFrame:
    """A row a band of each node, in order of the bands' keys within each partition."""
    return nodes.select(F.explode("bands").alias("key"), "node", "fp", "size", *columns).repartition("key").sortWithinPartitions("key", "node")


def with_first(nodes: DataFrame) -> DataFrame:
    """(a, b): each member of a band group of two or more with its group's first member if they may be copies, else with itself."""

    def run(batches):
        for rows in by_key(batches):
            key, node, fp, size = rows.T
            starts, sizes = starts_of(key)
            head = np.repeat(starts, sizes)
            got = np.repeat(sizes > 1, sizes)
            first = np.where(close(fp[head], fp, size[head], size), node[head], node)
            yield pa.RecordBatch.from_arrays([pa.array(first[got]), pa.array(node[got])], ["a", "b"])

    return banded(nodes).mapInArrow(run, "a long, b long")


def by_variants(nodes: DataFrame) -> DataFrame:
    """(a, b): texts whose fingerprints meet in the deletion-variant index, one of each fingerprint, and all of one fingerprint."""
    first = stage(nodes.groupBy("fp").agg(F.min("node").alias("head")), "fingerprint-heads")
    found = near_links(first.select("fp")).join(first.select(F.col("fp").alias("a"), F.col("head").alias("one")), "a").join(first.select(F.col("fp").alias("b"), F.col("head").alias("two")), "b")
    same = nodes.join(first, "fp").where("node <> head").select("head", "node")
    return found.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).union(same)


def left_apart(nodes: DataFrame) -> DataFrame:
    """(key, node): members of band groups that may be copies of a member with another ``root``."""

    def run(batches):
        for rows in by_key(batches):
            key, node, fp, size, root = rows.T
            found = [np.zeros(0, np.int64)]
            starts, sizes = starts_of(key)
            mixed = np.add.reduceat(np.append(root[1:] != root[:-1], False) & np.append(key[1:] == key[:-1], False), starts) > 0
            for s, n in zip(starts[mixed], sizes[mixed]):
                f, z, r, near = fp[s : s + n], size[s : s + n], root[s : s + n], np.zeros(n, bool)
                for i in range(n):
                    hit = close(f[i], f[i + 1 :], z[i], z[i + 1 :]) & (r[i + 1 :] != r[i])
                    near[i] |= hit.any()
                    near[i + 1 :] |= hit
                found.append(s + np.flatnonzero(near))
            at = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(node[at])], ["key", "node"])

    return banded(nodes, "root").mapInArrow(run, "key long, node long")


def joining(roots: np.ndarray, fps: np.ndarray, sizes: np.ndarray, same: Callable[[int, int], bool] | None) -> Iterator[tuple[int, int]]:
    """Places of pairs that link different roots: the first of each two components that is the ``same``, or all that may be."""
    group: dict[int, int] = {int(r): int(r) for r in roots}

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    for i in range(len(roots) - 1):
        for j in i + 1 + np.flatnonzero(close(fps[i], fps[i + 1 :], sizes[i], sizes[i + 1 :]) & (roots[i + 1 :] != roots[i])):
            a, b = root(int(roots[i])), root(int(roots[j]))
            if a != b:
                if same is None:
                    yield i, j
                elif same(i, j):
                    group[b] = a
                    yield i, j


def crossing(members: DataFrame, width: int) -> DataFrame:
    """(a, b, sure): links between roots inside each group of ``members`` (key, node, root, fp, size, text)."""

    def run(batches):
        key, rows, sets, held = None, [], [], 0

        def found() -> pa.RecordBatch:
            at = np.array(rows, np.int64).reshape(-1, 4)
            node, root, fp, size = at.T
            same = (lambda i, j: alike(sets[i], sets[j])) if len(sets) == len(rows) else None
            pairs = np.array([*joining(root, np.ascontiguousarray(fp), size, same)], np.int64).reshape(-1, 2)
            a, b = node[pairs[:, 0]], node[pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array([same is not None] * len(pairs), pa.bool_())], ["a", "b", "sure"])

        for batch in batches:
            for k, *ints, text in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5)):
                if k != key:
                    if len(rows) > 1:
                        yield found()
                    key, rows, sets, held = k, [], [], 0
                rows.append(ints)
                if held <= HELD_BYTES:
                    sets.append(np.unique(shingle_hashes(text.as_py() or "", width)))
                    held += sets[-1].nbytes
                    if held > HELD_BYTES:
                        sets.clear()
        if len(rows) > 1:
            yield found()

    keyed = members.select("key", "node", "root", "fp", "size", "text").repartition("key").sortWithinPartitions("key", "node")
    return keyed.mapInArrow(run, "a long, b long, sure boolean")


def verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose ``texts`` (node, text) have a similarity of LEAST or more."""

    def run(batches):
        last, words = None, set()
        for batch in batches:
            keep = []
            for a, one, two in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, words = a, set(shingles(one.as_py() or "", width))
                other = set(shingles(two.as_py() or "", width))
                both = len(words & other)
                keep.append(both >= LEAST * (len(words) + len(other) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("one"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def copy_classes(docs: DataFrame, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """(node, root) of every distinct text of ``docs`` (doc_id, text), by :func:`node_of`: its class of copies; and (doc_id, node) of every row."""
    prints = stage(signatures(docs, width), "signatures")
    kept = [F.first(c).alias(c) for c in ("fp", "size", "bands")]
    nodes = stage(prints.groupBy("node").agg(*kept), "distinct-texts")
    pairs = stage(by_variants(nodes).union(with_first(nodes)).distinct(), "candidates")
    asked = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "asked")
    # One text a node leaves each task; with a fixed kind of join the plan is one at all sizes.
    every = docs.select(node_of().alias("node"), "text").groupBy("node").agg(F.min("text").alias("text"))
    texts = stage(every.join(asked.hint("merge"), "node", "left_semi"), "texts")
    links = stage(verified(pairs.where("a <> b"), texts, width), "copies")
    roots = stage(components(links), "roots")
    rooted = nodes.join(asked, "node", "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stage(rooted, "rooted")
    apart = stage(left_apart(rooted), "left-apart")
    if not apart.isEmpty():
        more = stage(crossing(apart.join(rooted.drop("bands"), "node").join(texts, "node"), width), "crossing")
        sure = more.where("sure").select("a", "b").union(verified(more.where("NOT sure").select("a", "b").distinct(), texts, width))
        # The roots stand for the links before.
        roots = stage(components(stage(sure.union(roots.select("node", "root")), "all-links")), "roots")
        release(more)
    release(pairs, asked, texts, rooted, apart)
    classes = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return classes, prints.select("doc_id", "node")


def near_copies(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs`` (doc_id, text): the smallest doc_id
    reachable over pairs of similarity LEAST or more."""
    classes, rows = copy_classes(docs, width)
    firsts = stage(rows.groupBy("node").agg(F.min("doc_id").alias("first")).join(classes, "node"), "copy-classes")
    smallest = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(firsts.join(smallest, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
