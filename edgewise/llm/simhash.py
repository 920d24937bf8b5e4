"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most three bits differ in at most one bit
of their upper or of their lower half. Each half therefore goes into an index under 32
variants, each with one bit as a wildcard; fingerprints that share a variant are
verified by their full distance. Within a variant the verification grows components
from one member at a time against the members not yet reached, so a dense group costs
few comparisons and emits one link a member, never its pairs.

Defined cases: null, empty and blank texts have fingerprint zero and link like any
other; texts of fewer than ``width`` words are one shingle; exact copies share a
fingerprint and meet before the index; repeated rows each keep their row; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.llm.links import components
from edgewise.session import release, stage

SEED = 42
MAX_BITS = 3


def shingles(text: str, width: int) -> list[bytes]:
    """Shingles of one text, with repeats; fewer than ``width`` words are one."""
    words = text.encode().lower().split()
    if not words:
        return []
    return [*map(b" ".join, zip(*(words[k:] for k in range(width))))] if len(words) >= width else [b" ".join(words)]


def shingle_hashes(text: str, width: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(x, SEED) for x in shingles(text, width)), np.uint64)


def bits_of(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of ``hashes``."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int) -> int:
    """SimHash of the shingles of one text, with repeats."""
    return bits_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp long) for each row; one narrow pass."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "", width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): 64 one-wildcard half signatures of each distinct fingerprint."""
    slot = F.col("slot")
    half = F.when(slot < 32, F.col("fp")).otherwise(F.expr("shiftrightunsigned(fp, 32)")).bitwiseAND(F.lit(0xFFFFFFFF))
    bare = half.bitwiseAND(F.expr("~shiftleft(1L, cast(slot % 32 AS int))"))
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("slot")).select(F.expr("shiftleft(cast(slot AS bigint), 32)").bitwiseOR(bare).alias("key"), "fp")


def spanning(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join all members within ``bits`` bits, one for each member but the first of a component."""
    rest, out = np.unique(fps), []
    while len(rest) > 1:
        root, todo, rest = rest[0], [rest[0]], rest[1:]
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= bits
            if near.any():
                hit = rest[near]
                out += [(int(x), int(root)) for x in hit]
                todo += list(hit)
                rest = rest[~near]
    return out


def near_links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fps`` within ``bits`` <= 3 bits."""

    def pairs(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(values[two] ^ values[two + 1]) <= bits]
        a, b = [values[two]], [values[two + 1]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            if found := spanning(values[s : s + n], bits):
                got = np.array(found, np.uint64)
                a, b = [*a, got[:, 0]], [*b, got[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    def run(batches):
        # The rows come sorted by key; the last key of a batch waits for the next one.
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if held and held[0][0][0] != keys[-1] or last:
                held.append((keys[:last], values[:last]))
                yield pairs(*map(np.concatenate, zip(*held)))
                held = []
            held.append((keys[last:], values[last:]))
        if held:
            yield pairs(*map(np.concatenate, zip(*held)))

    keyed = variants(fps).repartition("key").sortWithinPartitions("key")
    return keyed.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable over fingerprints that differ in
    at most ``bits`` bits.
    """
    prints = stage(fingerprints(docs, width), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(near_links(distinct.select("fp"), bits))
    classes = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    classes = stage(classes, "fingerprint-classes")
    release(distinct)
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    of = classes.join(smallest, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")
