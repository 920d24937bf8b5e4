"""Searches as supersteps of one barrier stage: the level loop runs on the executors, not on the driver.

Vertices go by 64-bit numbers, and belong to the task that their number leaves as a remainder. Spark
deals each task the pairs that start at its vertices, sorted; the task keeps them in files that it maps,
so its memory follows the vertices, not the pairs. In a superstep every task sends what it found to the
owners. There are as many tasks as run at once; a lost task starts the stage over, from Spark's shuffle files.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.session import remove, shared_dir, stage

#: Rows of an Arrow batch that goes out.
ROWS = 1 << 16


def tasks(spark) -> int:
    """How many tasks a barrier stage may have here; 0 where Spark allows none."""
    sc = spark.sparkContext
    if str(sc.getConf().get("spark.dynamicAllocation.enabled", "false")).lower() == "true":
        return 0
    slots = sc.defaultParallelism
    if sc.getConf().get("spark.default.parallelism") is not None:  # may be more than run at once
        profile = sc._jsc.sc().resourceProfileManager().defaultResourceProfile()
        slots = sc._jsc.sc().maxNumConcurrentTasks(profile)
    else:
        slots //= int(sc.getConf().get("spark.task.cpus", "1"))
    return min(slots, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Peers:
    """The tasks of a barrier stage, and what they send each other: a file a task and superstep in the shared folder.

    The barrier's own messages take a second each, so only the first one, which agrees on a folder, is
    one; after that a task waits until the files of a superstep are there. If a task is lost, Spark ends all of the
    stage's tasks and starts it over, in a folder of its own.
    """

    def __init__(self, folder: str):
        from pyarrow import fs
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        self.me, self.n, self.round = context.partitionId(), len(context.getTaskInfos()), 0
        self.fs, base = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        self.folder = f"{base}/{context.allGather(uuid.uuid4().hex)[0]}"
        self.fs.create_dir(self.folder, recursive=True)

    def _name(self, round_: int, task: int) -> str:
        return f"{self.folder}/{round_}-{task}"

    def _exchange(self, parts: list[list]) -> Iterator[memoryview]:
        """Send ``parts[q]`` (buffers) to each task q; what they sent here, in their order."""
        ends = np.cumsum([0] + [sum(memoryview(x).nbytes for x in p) for p in parts]).astype("i8")
        name = self._name(self.round, self.me)
        with self.fs.open_output_stream(name + ".part") as out:
            out.write(ends.tobytes())
            for p in parts:
                for x in p:
                    out.write(x)
        self.fs.move(name + ".part", name)
        for q in range(self.n):
            wait, theirs = 0.0005, self._name(self.round, q)
            while not self._there(theirs):
                time.sleep(wait)
                wait = min(wait * 1.2, 0.02)
            with self.fs.open_input_file(theirs) as f:
                at = np.frombuffer(f.read_at(8 * (self.n + 1), 0), "i8")
                yield memoryview(f.read_at(int(at[self.me + 1] - at[self.me]), int(at[self.me]) + 8 * (self.n + 1)))
        if self.round > 0:  # read by all, since all are past it
            self.fs.delete_file(self._name(self.round - 1, self.me))
        self.round += 1

    def _there(self, name: str) -> bool:
        return self.fs.get_file_info(name).size is not None

    def gather(self, value: int) -> list[int]:
        """The numbers of all tasks, in their order."""
        return [int(np.frombuffer(x, "i8")[0]) for x in self._exchange([[np.int64(value).tobytes()]] * self.n)]

    def swap(self, owner: np.ndarray, *columns: np.ndarray) -> tuple[int, list[np.ndarray]]:
        """Send each row to its owner: how many rows all tasks sent, and the rows that came, sender by sender."""
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(self.n + 1))
        columns = [np.ascontiguousarray(c[order]) for c in columns]
        sent, width, parts, total = np.int64(len(owner)).tobytes(), sum(c.itemsize for c in columns), [], 0
        for data in self._exchange([[sent, *(c[ends[q] : ends[q + 1]].view("u1") for c in columns)] for q in range(self.n)]):
            total += int(np.frombuffer(data, "i8", 1)[0])
            rows, start, part = (len(data) - 8) // width, 8, []
            for c in columns:
                part.append(np.frombuffer(data, c.dtype, rows, start))
                start += rows * c.itemsize
            parts.append(part)
        return total, [np.concatenate([p[k] for p in parts]) for k in range(len(columns))]


class _File:
    """Rows of one type appended to a file in the task's own temporary folder, then mapped."""

    def __init__(self, dtype):
        self.file, self.dtype, self.n = tempfile.TemporaryFile(), np.dtype(dtype), 0

    def add(self, x: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(x, self.dtype).tobytes())
        self.n += len(x)

    def rows(self) -> np.ndarray:
        self.file.flush()
        return np.memmap(self.file, self.dtype, "r", shape=(self.n,)) if self.n else np.empty(0, self.dtype)


class Links:
    """A task's vertices in the order of their numbers, and the pairs that start at them."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        v, to, mark, degree, starts, last = _File("i8"), _File("i8"), _File("i1"), _File("i8"), [], None
        open_ = 0  # pairs of the last vertex so far
        for b in batches:
            if not b.num_rows:
                continue
            at, dst, key = b.column(0).to_numpy(), b.column(1), b.column(3)
            has = dst.is_valid().to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[last is None or at[0] != last], at[1:] != at[:-1]]))
            n = np.add.reduceat(has.astype("i8"), np.union1d(first, [0]))
            if len(first) and first[0] == 0:
                if last is not None:
                    degree.add(np.array([open_]))
                open_ = 0
            n[0] += open_
            degree.add(n[:-1])
            open_, last = int(n[-1]), at[-1]
            v.add(at[first])
            to.add(dst.drop_null().to_numpy())
            mark.add(b.column(2).drop_null().to_numpy())
            named = key.is_valid().to_numpy(zero_copy_only=False)
            if named.any():
                starts.append((at[named], key.drop_null().to_numpy(), b.column(4).drop_null().to_numpy()))
        if last is not None:
            degree.add(np.array([open_]))
        self.v, self.to, self.mark = v.rows(), to.rows(), mark.rows()
        self.first = np.concatenate([[0], np.cumsum(degree.rows())]).astype("i8")
        self.starts = [np.concatenate(x) for x in zip(*starts)] if starts else [np.empty(0, "i8")] * 3

    def __len__(self) -> int:
        return len(self.v)

    def place(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.v, numbers)

    def ahead(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair that starts at ``places``: which of them, its place among the vertex's pairs, and where it lies."""
        first = self.first[places]
        return ranges(first, self.first[places + 1] - first)


def ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges one behind another: the number of the range, the step in it, and the position."""
    which = np.repeat(np.arange(len(first)), size)
    step = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return which, step, first[which] + step


def least(by: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """The positions of the rows with the least ``by`` of each distinct ``keys``, in the order of the keys."""
    order = np.lexsort((by, *reversed(keys)))
    if not len(order):
        return order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order[new]


def run(links: DataFrame, program: Callable[[Peers, Links], Iterator[tuple]], schema: str, name: str) -> DataFrame:
    """The rows that ``program`` yields, as tuples of arrays, written once. ``links`` come from :func:`dealt`."""
    spark = links.sparkSession
    folder = f"{shared_dir(spark)}/edgewise/{name}-{uuid.uuid4().hex}"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def task(batches):
        peers = Peers(folder)
        for rows in program(peers, Links(batches)):
            for k in range(0, len(rows[0]), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + ROWS], t) for c, t in zip(rows, types)], names)

    out = stage(links.mapInArrow(task, schema, barrier=True), name)
    remove(spark, folder)
    return out


def dealt(pairs: DataFrame, starts: DataFrame) -> DataFrame:
    """Pairs (v, to, mark) and starts (v, key, rank) at the task that owns v, sorted; each end of a pair has a row of its own."""
    n = tasks(pairs.sparkSession)
    none = lambda t: F.lit(None).cast(t)
    rows = pairs.select("v", "to", F.col("mark").cast("byte"), none("long").alias("key"), none("long").alias("rank"))
    rows = rows.union(pairs.select(F.col("to").alias("v"), none("long"), none("byte"), none("long"), none("long")))
    rows = rows.union(starts.select("v", none("long"), none("byte"), F.col("key").cast("long"), F.coalesce(F.col("rank").cast("long"), F.lit(0))))
    return rows.repartitionById(n, F.expr(f"CAST(pmod(v, {n}) AS INT)")).sortWithinPartitions("v", "to")


def number(id: Column | str, salt: int = 0) -> Column:
    """A 64-bit number of an id. Whoever turns numbers back looks whether two ids share one (:func:`named`)."""
    return F.xxhash64(id) if not salt else F.xxhash64(id, F.lit(salt))


def named(found: DataFrame, ids: DataFrame, salt: int = 0) -> DataFrame | None:
    """``found`` with the ids of its numbers v, written once; None if two ids of ``ids`` (id) have a number that was found."""
    wanted = found.select("v").distinct()
    names = ids.where("id IS NOT NULL").select(number("id", salt).alias("v"), "id").join(wanted, "v", "left_semi").distinct()
    out = stage(found.join(names, "v").drop("v"), "named")
    return out if out.count() == found.count() else None


# Searches


def search(depth: int | None, ranked: bool, parents: bool, bound: int):
    """Breadth-first search of every key: (key, v, depth, parent, rank). Ranked, ``starts`` carry ranks under ``bound``;
    what a vertex finds is numbered behind what the vertices before it find, so ranks stay in order and have gaps."""

    def program(peers: Peers, links: Links):
        seen: dict[int, np.ndarray] = {}

        def fresh(key: np.ndarray, place: np.ndarray) -> np.ndarray:
            """Which rows are new; they count as seen from now on. Rows are distinct and in the order of keys."""
            out = np.zeros(len(key), bool)
            ks, at = np.unique(key, return_index=True)
            for k, a, b in zip(ks.tolist(), at, [*at[1:], len(key)]):
                if k not in seen:
                    seen[k] = np.zeros(len(links), bool)
                out[a:b] = ~seen[k][place[a:b]]
                seen[k][place[a:b]] = True
            return out

        v, key, rank = links.starts
        keep = least(rank, key, v)
        key, place, rank = key[keep], links.place(v[keep]), rank[keep]
        fresh(key, place)
        none, level, most = np.full(len(key), -1, "i8"), 0, bound
        parent = none
        while True:
            yield key, np.asarray(links.v[place]), np.full(len(key), level, "i4"), parent, rank
            if level == depth:
                return
            size = links.first[place + 1] - links.first[place]
            which, step, at = links.ahead(place)
            dst, keys = np.asarray(links.to[at]), key[which]
            by = np.zeros(len(dst), "i8")
            if ranked:
                offset, most = _offsets(peers, rank, size, most)
                by = offset[which] + step
            elif parents:
                by = np.asarray(links.v[place])[which]
            keep = least(by, keys, dst)
            sent = [keys[keep], dst[keep]]
            if ranked or parents:
                sent.append(by[keep])
            if ranked:
                sent.append(np.asarray(links.v[place])[which][keep])
            total, (key, dst, *rest) = peers.swap(sent[1] % peers.n, *sent)
            if not total:
                return
            by = rest[0] if rest else np.zeros(len(key), "i8")
            keep = least(by, key, dst)
            key, place = key[keep], links.place(dst[keep])
            new = fresh(key, place)
            keep, key, place = keep[new], key[new], place[new]
            by = by[keep]
            rank, parent = (by, rest[1][keep]) if ranked else (np.zeros(len(key), "i8"), by)
            level += 1

    return program


def _offsets(peers: Peers, rank: np.ndarray, size: np.ndarray, bound: int) -> tuple[np.ndarray, int]:
    """The sum of the sizes at smaller ranks of all tasks, and of all sizes. A task adds up a range of the ranks below ``bound``."""
    block = bound // peers.n + 1
    _, (r, s, who, row) = peers.swap(rank // block, rank, size, np.full(len(rank), peers.me, "i8"), np.arange(len(rank)))
    order = np.argsort(r, kind="stable")
    sums = np.empty(len(r), "i8")
    sums[order] = np.cumsum(s[order]) - s[order]
    totals = peers.gather(int(s.sum()))
    _, (row, before) = peers.swap(who, row, sums + sum(totals[: peers.me]))
    out = np.empty(len(rank), "i8")
    out[row] = before
    return out, sum(totals)


# Multi-root traversal

HELD, WEAK, CUT = 0, 1, 2


def spread(depth: int, most: int, decisive: int, grade: bool):
    """Rows (v, root, level, kind): the roots that each vertex HELD, the WEAK vertices that some root reaches over all pairs but not
    over marked ones, and a row CUT if one more step would count. See ``traversal.spread_roots`` and ``traversal.unsure``."""

    def held(peers: Peers, links: Links):
        v, key, _ = links.starts
        place, over = links.place(v), max(peers.gather(int(key.max()) if len(key) else 0)) + 1
        own = np.full(len(links), -1, "i8")
        order = np.argsort(-key, kind="stable")
        own[place[order]] = key[order]
        have = np.unique(place * over + key)
        when, new, cut = np.zeros(len(have), "i4"), have, False
        for level in range(1, depth + 2):
            which, _, at = links.ahead(new // over)
            dst, root = np.asarray(links.to[at]), (new % over)[which]
            keep = least(root, dst, root)
            total, (dst, root) = peers.swap(dst[keep] % peers.n, dst[keep], root[keep])
            if not total:
                break
            come = np.unique(links.place(dst) * over + root)
            at = np.searchsorted(have, come)
            known = np.zeros(len(come), bool)
            inside = at < len(have)
            known[inside] = have[at[inside]] == come[inside]
            come, at = come[~known], at[~known]  # a vertex holds its own root from the start
            place, root = come // over, come % over
            if level > depth:
                smaller = at - np.searchsorted(have, place * over) - ((own[place] >= 0) & (own[place] < root))
                cut = bool((smaller < decisive).any())
                break
            asked = np.unique(place)
            first = np.searchsorted(have, asked * over)
            others = have[ranges(first, np.searchsorted(have, (asked + 1) * over) - first)[2]]
            others = others[others % over != own[others // over]]
            both = np.concatenate([others, come])
            order = np.argsort(both, kind="stable")
            at_vertex = both[order] // over
            smaller = np.arange(len(both)) - np.searchsorted(at_vertex, at_vertex)
            new = both[order][(order >= len(others)) & (smaller < most)]
            at = np.searchsorted(have, new)
            have, when = np.insert(have, at, new), np.insert(when, at, level)
        return have // over, have % over, when, cut

    def weak(peers: Peers, links: Links) -> np.ndarray:
        """Roots are bits of 64-bit words; the words of all pairs have even codes, those of marked pairs odd ones."""
        v, key, _ = links.starts
        place, words = links.place(v), {}
        code, place, new = _joined(*(np.concatenate(x) for x in ((key // 64 * 2, key // 64 * 2 + 1), (place, place))), np.tile(np.left_shift(np.uint64(1), (key % 64).astype("u8")), 2))
        for _ in range(depth + 1):
            fresh = np.zeros(len(code), "u8")
            cs, at = np.unique(code, return_index=True)
            for c, a, b in zip(cs.tolist(), at, [*at[1:], len(code)]):
                if c not in words:
                    words[c] = np.zeros(len(links), "u8")
                fresh[a:b] = new[a:b] & ~words[c][place[a:b]]
                words[c][place[a:b]] |= new[a:b]
            if _ == depth:
                break
            some = fresh != 0
            which, _step, at = links.ahead(place[some])
            dst, code, new = np.asarray(links.to[at]), code[some][which], fresh[some][which]
            keep = (code % 2 == 0) | (links.mark[at] != 0)
            code, dst, new = _joined(code[keep], dst[keep], new[keep])
            total, (code, dst, new) = peers.swap(dst % peers.n, code, dst, new)
            if not total:
                break
            code, place, new = _joined(code, links.place(dst), new)
        out = np.zeros(len(links), bool)
        for c in words:
            if c % 2 == 0:
                out |= words[c] != words.get(c + 1, np.uint64(0))
        return np.flatnonzero(out)

    def program(peers: Peers, links: Links):
        row = lambda v, root, level, kind: (v, root, level, np.full(len(v), kind, "i4"))
        place, root, level, cut = held(peers, links)
        yield row(np.asarray(links.v[place]), root, level, HELD)
        if grade:
            at = weak(peers, links)
            yield row(np.asarray(links.v[at]), np.zeros(len(at), "i8"), np.zeros(len(at), "i4"), WEAK)
        if cut:
            yield row(*np.zeros((3, 1), "i8"), CUT)

    return program


def _joined(code: np.ndarray, place: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row a (code, place), in their order, with the bits of all."""
    order = np.lexsort((place, code))
    code, place, bits = code[order], place[order], bits[order]
    if not len(code):
        return code, place, bits
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (place[1:] != place[:-1])]))
    return code[first], place[first], np.bitwise_or.reduceat(bits, first)


# Strongly connected components


def cores():
    """Rows (v, colour): the vertices on cycles of more than one vertex and a number that each cycle's vertices share. Pairs come both
    ways round, those backwards marked, once each. Vertices without ways in or out are taken off; of the rest the
    least number spreads forward, and from where it stayed its own a backward search inside it yields a component."""

    def program(peers: Peers, links: Links):
        n, v = len(links), np.asarray(links.v)
        alive, colour, found = np.ones(n, bool), np.empty(n, "i8"), np.zeros(n, bool)
        source = np.repeat(np.arange(n), np.diff(links.first))
        back = np.asarray(links.mark) != 0
        degree = [np.bincount(source[back], minlength=n), np.bincount(source[~back], minlength=n)]  # ways in, ways out
        del source

        def neighbours(place: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
            which, _, at = links.ahead(place)
            keep = back[at] == backward
            return which[keep], np.asarray(links.to[at[keep]])

        def take_off(place: np.ndarray) -> None:
            """And whatever has no way in or out then."""
            while True:
                alive[place] = False
                a, b = neighbours(place, False)[1], neighbours(place, True)[1]
                dst, side = np.concatenate([a, b]), np.repeat(np.array([0, 1], "i1"), (len(a), len(b)))
                total, (dst, side) = peers.swap(dst % peers.n, dst, side)
                if not total:
                    return
                at = links.place(dst)
                for k in (0, 1):
                    np.subtract.at(degree[k], at[side == k], 1)
                at = np.unique(at)
                place = at[alive[at] & ((degree[0][at] <= 0) | (degree[1][at] <= 0))]

        def wave(place: np.ndarray, backward: bool, take: Callable) -> None:
            while True:
                which, dst = neighbours(place, backward)
                c = colour[place][which]
                keep = least(c, c, dst) if backward else least(c, dst)
                total, (dst, c) = peers.swap(dst[keep] % peers.n, dst[keep], c[keep])
                if not total:
                    return
                place = take(links.place(dst), c)

        def lower(at: np.ndarray, c: np.ndarray) -> np.ndarray:
            keep = least(c, at)
            at, c = at[keep], c[keep]
            fell = alive[at] & (c < colour[at])
            colour[at[fell]] = c[fell]
            return at[fell]

        def claim(at: np.ndarray, c: np.ndarray) -> np.ndarray:
            at = np.unique(at[alive[at] & ~found[at] & (c == colour[at])])
            found[at] = True
            return at

        take_off(np.flatnonzero((degree[0] == 0) | (degree[1] == 0)))
        while sum(peers.gather(int(alive.sum()))):
            place = np.flatnonzero(alive)
            colour[place] = v[place]
            wave(place, False, lower)
            found[:] = False
            place = np.flatnonzero(alive & (colour == v))
            found[place] = True
            wave(place, True, claim)
            place = np.flatnonzero(found)
            yield v[place], colour[place]
            take_off(place)

    return program
