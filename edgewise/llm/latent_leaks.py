"""Benchmark decontamination by latent semantic retrieval.

Words (lower case, outer marks off) become 32-bit ids by hash; the latent space has TERMS
terms, their lower bits, while the checks go by whole ids, which one pair of words in four
billion shares. TF-IDF passages are
projected on the leading right singular vectors of the passage-term matrix, found by a
distributed randomised SVD. Every document is searched in windows of 32 words, a new one
each 16 words; a window whose cosine with a part of a benchmark item is high enough is a
candidate. Items that would leave much of such a window empty have windows of 16, 8 or 4
words (``SHORT_STEPS``), and the least cosine falls with the share that an item fills. Candidates are verified by the longest common subsequence of the item and the
words around the window, and below a near-verbatim match also by the item's answer, its
closing words.

Term counts and the SVD, the index of the method, cover all passages of the corpus and the
items (``FIT_PASSAGES`` may bound the fit). Every window
of every document is searched; items are taken in blocks of ``ITEM_BLOCK``.

Defined cases: null and empty texts have no window; texts under 32 words are one window;
items without words never match; items under ``TOGETHER`` words only match words that stand together; repeated rows and equal items each give their rows;
extra columns are ignored; an empty benchmark gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.session import stage

#: Terms of the latent space: ids are folded to as many by their lower bits.
TERMS = 1 << 14
RANK, OVERSAMPLE, ROUNDS, SEED = 64, 8, 2, 5
PASSAGE = 64
#: About as many passages, of documents picked by hash, are fitted; all of them without a number.
FIT_PASSAGES: int | None = None
#: Words of passages that are multiplied with the basis together, and pieces that the product is added up in.
FIT_WORDS = 1 << 20
PARTS = 16
#: Rows added at a time to the product of a term.
GROUP = 16
#: Words of half a window: for items of up to so many words, and for longer ones.
SHORT_STEPS, STEP = {2: 3, 4: 7, 8: 23}, 16
#: Least cosine of a window and an item that fills it; less by the root of the share that the item fills.
COSINE = 0.5
#: Items of fewer words must keep their words together: they are compared with runs of their own length.
TOGETHER = 8
VERBATIM, PARAPHRASE, ANSWER = 0.75, 0.65, 0.9
ITEM_BLOCK = 10_000
MARKS = b".,;:!?\"'()[]{}#*$%&|<>-_/"
CHUNK = 200_000
#: Windows and item parts that are multiplied at a time.
TILE = 4096
#: Rows of a table that are gathered at a time, so that they stay in the cache until they are summed.
GATHER = 2048
#: Candidate stretches that are checked at a time, and bits that tell which words a block holds.
STRETCHES = 1024
#: Ids that agree in these lower bits have one term and one bit in common.
OCCURS = 1 << 16
BLOCK_BITS = OCCURS >> 6


class Ids(dict):
    """32-bit ids of words in lower case, kept for words seen before; 0 for marks alone."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        bare = word.strip(MARKS)
        if len(self) > 1_000_000:
            self.clear()
        got = self[word] = (xxh3_64_intdigest(bare) & 0xFFFFFFFF or 1) if bare else 0
        return got

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        ids = np.fromiter(map(self.__getitem__, words), np.uint32, len(words))
        return ids[ids != 0]


IDS = Ids()


def step_of(n: int) -> int:
    """Words of half a window for an item of ``n`` words."""
    return next((step for step, most in SHORT_STEPS.items() if n <= most), STEP)


def terms_of(ids: np.ndarray) -> np.ndarray:
    return (ids & np.uint32(TERMS - 1)).astype(np.int64)


def word_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, ids binary): little-endian 32-bit word ids of each row."""

    def run(batches):
        for batch in batches:
            got = [IDS(t.as_py()).astype("<u4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(got, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def _chunks(batches):
    """Concatenated term ids with the number of the passage of each, chunk by chunk."""
    ids, passages, held, n = [], [], 0, 0
    for batch in batches:
        for raw in batch.column(0):
            x = terms_of(np.frombuffer(raw.as_py(), "<u4"))
            if not len(x):
                continue
            ids.append(x)
            passages.append(n + np.arange(len(x)) // PASSAGE)
            n += -(-len(x) // PASSAGE)
            held += len(x)
            if held >= CHUNK:
                yield np.concatenate(ids), np.concatenate(passages), n
                ids, passages, held, n = [], [], 0, 0
    if ids:
        yield np.concatenate(ids), np.concatenate(passages), n


def passage_counts(ids: DataFrame) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and all passages."""

    def run(batches):
        total, passages = np.zeros(TERMS, np.int64), 0
        for x, p, n in _chunks(batches):
            # A chunk has at most as many passages as words, so the key fits 32 bits, which sort faster.
            key = np.sort((p * TERMS + x).astype(np.uint32))
            key = key[np.append(True, key[1:] != key[:-1])]
            total += np.bincount(key % np.uint32(TERMS), minlength=TERMS)
            passages += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], passages), pa.int64())], ["term", "n"])

    df, n = np.zeros(TERMS, np.int64), 0
    for r in ids.select("ids").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r.term < 0:
            n = r.n
        else:
            df[r.term] = r.n
    return df, n


def row_sums(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``table`` named by each row of ``at``."""
    n = at.shape[1]
    ones, out = np.ones((1, n), table.dtype), np.empty((len(at), table.shape[1]), table.dtype)
    some = max(1, GATHER // n)
    for s in range(0, len(at), some):
        held = table.take(at[s : s + some].ravel(), 0).reshape(-1, n, table.shape[1])
        out[s : s + some] = (ones @ held)[:, 0]
    return out


def _passages(batches):
    """Terms of passages as rows of PASSAGE places, empty ones TERMS, about ``FIT_WORDS`` at a time."""
    held, n = [], 0
    for batch in batches:
        for raw in batch.column(0):
            x = terms_of(np.frombuffer(raw.as_py(), "<u4"))
            if not len(x):
                continue
            held += [x, np.full(-len(x) % PASSAGE, TERMS)]
            n += len(x)
            if n >= FIT_WORDS:
                yield np.concatenate(held).reshape(-1, PASSAGE)
                held, n = [], 0
    if held:
        yield np.concatenate(held).reshape(-1, PASSAGE)


def term_sums(passages: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of ``passages`` and for each the sum of the rows of its passages, one an occurrence."""
    flat = passages.ravel()
    counts = np.bincount(flat, minlength=TERMS + 1)[:TERMS]
    by = np.argsort(flat.astype(np.uint16), kind="stable")[: counts.sum()]
    # The occurrences of a term fill groups of their own; spare places name a row of zeros.
    groups = -(-counts // GROUP)
    first = np.cumsum(groups) - groups
    at = np.full(groups.sum() * GROUP, len(rows))
    at[np.arange(len(by)) + np.repeat(first * GROUP - (np.cumsum(counts) - counts), counts)] = by // passages.shape[1]
    sums = row_sums(np.vstack([rows, np.zeros((1, rows.shape[1]), rows.dtype)]), at.reshape(-1, GROUP))
    terms = np.flatnonzero(counts)
    return terms, np.add.reduceat(sums, first[terms])


def singular_space(ids: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF passages in ``ids`` (ids), each over its
    singular value: what folds a text into the space of the left vectors, where common words weigh little.

    Each round multiplies the basis by the matrix and its transpose in every task and adds
    the products, of fixed size, piece by piece before the next QR step.
    """
    width = RANK + OVERSAMPLE
    basis = np.linalg.qr(np.random.default_rng(SEED).normal(size=(TERMS, width)))[0]
    cuts = np.array_split(np.arange(TERMS), PARTS)
    pieces = "k int, task int, part binary"
    for _ in range(ROUNDS):
        # The last column is the square of the weight: its sum over a passage is the square of the norm.
        weighted = np.vstack([np.column_stack([idf[:, None] * basis, idf**2]), np.zeros((1, width + 1))]).astype(np.float32)

        def run(batches):
            from pyspark import TaskContext

            total = None
            for x in _passages(batches):
                rows = row_sums(weighted, x)
                terms, sums = term_sums(x, rows[:, :-1] / np.maximum(rows[:, -1:], 1e-9))
                total = np.zeros((TERMS, width)) if total is None else total
                total[terms] += sums * idf[terms][:, None]
            if total is not None:
                parts = [total[c].astype("<f4").tobytes() for c in cuts]
                yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([TaskContext.get().partitionId()] * PARTS, pa.int32()), pa.array(parts, pa.binary())], ["k", "task", "part"])

        def add(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, part in zip(batch.column(0).to_pylist(), batch.column(2)):
                    x = np.frombuffer(part.as_py(), "<f4").astype(np.float64)
                    sums[k] = sums[k] + x if k in sums else x
            yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["k", "task", "part"])

        found = np.zeros((TERMS, width))
        for r in ids.mapInArrow(run, pieces).repartition(PARTS, "k").sortWithinPartitions("k", "task").mapInArrow(add, pieces).toLocalIterator():
            found[cuts[r.k]] = np.frombuffer(r.part, np.float64).reshape(-1, width)
        if not found.any():
            return basis[:, :RANK]
        basis, squares, _ = np.linalg.svd(found, full_matrices=False)
    # Fewer passages than the rank leave directions without any.
    used = squares[:RANK] > 1e-7 * squares[0]
    return basis[:, :RANK] * np.where(used, 1 / np.sqrt(np.where(used, squares[:RANK], 1.0)), 0.0)


def common_subsequence(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, a word at a time over bits of the item."""
    at: dict[int, int] = {}
    for j, x in enumerate(item):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(item)) - 1
    v = full
    for y in words:
        if m := at.get(y):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def answer_of(item: list[int]) -> list[int]:
    """The closing words of an item: its last quarter, three words at least."""
    return item[-max(3, len(item) // 4) :]


class Items:
    """Benchmark items of one block: their words and the unit vectors of their parts."""

    def __init__(self, rows: list[tuple], space: np.ndarray):
        self.space = np.vstack([space, np.zeros((1, space.shape[1]))]).astype(np.float32)
        self.ids, self.words, self.of, vectors, steps = [], [], [], [], []
        for item_id, text in rows:
            x = IDS(text)
            if not len(x):
                continue
            steps.append(step := step_of(len(x)))
            for s in range(0, max(1, len(x) - 2 * step + step // 2), max(1, step // 2)):
                vectors.append(self.space[terms_of(x[s : s + 2 * step])].sum(0))
                self.of.append(len(self.ids))
            self.ids.append(item_id)
            self.words.append(x.tolist())
        v = np.array(vectors, np.float32).reshape(-1, space.shape[1])
        self.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        self.of = np.array(self.of, np.int64)
        self.steps = np.array(steps, np.int64)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(w, np.uint32) for w in self.words)]) & np.uint32(BLOCK_BITS - 1)
        self.flat = self.flat.astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def candidates(self, docs: list[np.ndarray], least: float):
        """Document, item, step and cosine, as arrays, of each window and item part that are close."""
        blocks = np.array([max(1, -(-len(x) // STEP)) for x in docs])
        flat = np.full(blocks.sum() * STEP, TERMS, np.int64)
        at = np.concatenate([[0], np.cumsum(blocks)])
        for s, x in zip(at, docs):
            flat[s * STEP : s * STEP + len(x)] = terms_of(x)
        out = [(at[:0], self.of[:0], at[:0], np.zeros(0, np.float32))]
        used = sorted(set(self.steps.tolist())) or [STEP]
        size = used[0]
        sums = row_sums(self.space, flat.reshape(-1, size))
        for step in used:
            sums, size = sums.reshape(-1, step // size, self.space.shape[1]).sum(1), step
            owner = np.repeat(np.arange(len(docs)), blocks * (STEP // step))
            out.extend(self._close(sums, owner, at * (STEP // step), step, least))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _close(self, sums: np.ndarray, owner: np.ndarray, at: np.ndarray, step: int, least: float):
        """The same for the items of one ``step``; ``sums`` are those of the half windows, ``at`` the first one of each document."""
        parts = np.flatnonzero(self.steps[self.of] == step)
        of, vectors = self.of[parts], self.vectors[parts]
        least = (least * np.sqrt(np.minimum(1, self.sizes[of] / (2 * step)))).astype(np.float32)
        inner = np.append(owner[1:] == owner[:-1], False)
        windows = sums.copy()
        windows[inner] += sums[np.flatnonzero(inner) + 1]
        windows /= np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-9)
        for s in range(0, len(windows), TILE):
            for k in range(0, len(vectors), TILE):
                near = windows[s : s + TILE] @ vectors[k : k + TILE].T
                w, v = np.divmod(np.flatnonzero(near >= least[k : k + TILE]), near.shape[1])
                yield owner[w + s], of[v + k], w + s - at[owner[w + s]], near[w, v]

    def stretches(self, docs: list[np.ndarray], least: float):
        """Document, item, first and last step and largest cosine, as arrays, of each stretch of close windows
        whose surroundings may hold enough of the item's words. Bits of the word ids tell; they never rule out a word that is there."""
        owner, of, step, cosine = self.candidates(docs, least)
        if not len(owner):
            return owner, of, step, step, cosine
        # One number for document, item and step; pairs are further apart than any two steps of one.
        wide = int(step.max()) + 4
        key = (owner * len(self.ids) + of) * wide + step
        by = np.argsort(key)
        key = key[by]
        starts = np.flatnonzero(np.append(True, np.diff(key) > 3))
        pair, a = np.divmod(key[starts], wide)
        d, i = np.divmod(pair, len(self.ids))
        b = key[np.append(starts[1:], len(key)) - 1] % wide
        best = np.maximum.reduceat(cosine[by], starts)
        sizes = np.array([len(x) for x in docs])
        blocks = -(-sizes // STEP)
        first = np.cumsum(blocks) - blocks
        bits = np.zeros((blocks.sum(), BLOCK_BITS), bool)
        bits[np.repeat(first, sizes) + np.concatenate([np.arange(n) // STEP for n in sizes]), np.concatenate(docs) & np.uint32(BLOCK_BITS - 1)] = True
        bits = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        low, high = self.surroundings(i, a, b)
        low, high = first[d] + low // STEP, first[d] - (-np.minimum(high, sizes[d]) // STEP)
        live, level, span = np.zeros(len(starts), bool), np.frexp(high - low)[1] - 1, 1
        # ``bits`` are those of ``span`` blocks; two such rows, which may overlap, cover a stretch.
        for k in range(level.max() + 1):
            if k:
                bits, span = bits[:-span] | bits[span:], 2 * span
            at = np.flatnonzero(level == k)
            for some in np.split(at, range(STRETCHES, len(at), STRETCHES)) if len(at) else []:
                held = np.unpackbits((bits[low[some]] | bits[high[some] - span]).view(np.uint8), axis=1, bitorder="little").ravel()
                m = self.sizes[i[some]]
                ends = np.cumsum(m)
                words = self.flat[np.arange(ends[-1]) + np.repeat(self.first[i[some]] - (ends - m), m)]
                live[some] = np.add.reduceat(held.take(words + np.repeat(np.arange(len(m)) * BLOCK_BITS, m)), ends - m, dtype=np.int64) >= PARAPHRASE * m
        return d[live], i[live], a[live], b[live], best[live]

    def surroundings(self, i, a, b):
        """First word and end of what is compared with item ``i`` for close windows from step ``a`` to ``b``."""
        return np.maximum(0, a * self.steps[i] - self.sizes[i]), (b + 2) * self.steps[i] + self.sizes[i]

    def verify(self, docs: list[np.ndarray], least: float):
        """(document, item, first word, cosine, subsequence, answer) of each candidate that holds enough of the item's words."""
        found: dict[tuple[int, int], tuple] = {}
        d, i, a, b, cosine = self.stretches(docs, least)
        low, high = self.surroundings(i, a, b)
        for d, i, start, end, c in zip(d.tolist(), i.tolist(), low.tolist(), high.tolist(), cosine.tolist()):
            item, near = self.words[i], docs[d][start:end].tolist()
            if sum(map(set(near).__contains__, item)) >= PARAPHRASE * len(item):
                answer = answer_of(item)
                n = len(item) if len(item) < TOGETHER else len(near)
                runs_of = [near[k : k + n] for k in range(max(1, len(near) - n + 1))]
                part = max(common_subsequence(item, x) for x in runs_of) / len(item)
                kept = max(common_subsequence(answer, x) for x in runs_of) / len(answer)
                found[d, i] = max(found.get((d, i), (-1.0,)), (part, kept, c, start))
        for (d, i), best in found.items():
            yield d, i, best[3], best[2], best[0], best[1]


SCHEMA = "doc_id long, item_id long, start long, cosine double, subsequence double, answer double"


def search(ids: DataFrame, items: Items, least: float) -> DataFrame:
    """Candidates, with their checks, of all documents ``ids`` against ``items``."""

    def run(batches):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64()] * 3 + [pa.float64()] * 3
        for batch in batches:
            keys, docs, held = [], [], 0
            rows: list[tuple] = []

            def flush():
                rows.extend((keys[d], items.ids[i], s, c, p, a) for d, i, s, c, p, a in items.verify(docs, least))

            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(raw.as_py(), "<u4")
                if len(x):
                    keys.append(doc_id)
                    docs.append(x)
                    held += len(x)
                if held >= CHUNK:
                    flush()
                    keys, docs, held = [], [], 0
            if docs:
                flush()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return ids.mapInArrow(run, SCHEMA)


def candidates(docs: DataFrame, benchmark: DataFrame, least: float = COSINE) -> DataFrame:
    """All candidates of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text) with their checks."""
    ids = stage(word_ids(docs), "word-ids")
    df, n = passage_counts(ids)
    idf = np.log((1 + n) / (1 + df)) + 1
    fitted = ids
    if FIT_PASSAGES is not None:
        fitted = ids.where(F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(max(1, n // FIT_PASSAGES))) == 0)
    fitted = fitted.union(word_ids(benchmark.select(F.col("item_id").alias("doc_id"), "text"))).select("ids")
    # The weights of both sides: those of the fitted passages and those of what is folded in.
    space = singular_space(fitted, idf) * idf[:, None] ** 2
    spark, out = docs.sparkSession, None
    blocks = max(1, -(-benchmark.count() // ITEM_BLOCK))
    for k in range(blocks):
        some = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).select("item_id", "text").collect()
        found = search(ids, Items([(r.item_id, r.text) for r in some], space), least) if some else spark.createDataFrame([], SCHEMA)
        out = found if out is None else out.union(found)
    return out


def leaked():
    """Verdict on a candidate: near-verbatim, or a paraphrase that keeps the answer."""
    return (F.col("subsequence") >= VERBATIM) | ((F.col("subsequence") >= PARAPHRASE) & (F.col("answer") >= ANSWER))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, cosine, subsequence, answer) of each document and item that it contains."""
    return candidates(docs, benchmark).where(leaked())
