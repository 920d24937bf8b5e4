"""Hierarchical Pitman-Yor language model of word pairs over word classes, seated by Gibbs sampling.

Every word that occurs has a restaurant of its own for the words that follow it. Its parent
is a model of classes: the ``TOP`` most frequent tokens are classes of their own, all others
share one; a restaurant stands for each preceding class, and all share one parent, whose base
is uniform. Within the shared class a further restaurant serves the single words, over a base
that gives half its mass to words never seen. The parent's probability of a token is
P(class | class before) times P(word | shared class), which sums to one over the known words
and one unknown word, and so does the model over each word.

A pair of two of the ``TOP`` words is its classes' own pair, and stays with them. The rare
words after a frequent one are dealt over ``SLICES`` restaurants by hash, each over its share
of the parent's mass, so that no restaurant grows with a frequent word.

Counts of words, of class pairs and of word pairs are taken over all training texts. A seating
sweep draws the number of tables of every (restaurant, dish) anew, given the totals of the last
sweep; predictive probabilities are averaged over the sweeps after burn-in. The table of
class pairs has a fixed size, so it is sampled on the driver; words of the shared class only
matter there by their count, of which there are at most the square root of twice the tokens.
Restaurants of words are dealt to buckets by hash and seated there; the discount is that of
the bucket's pairs.

Scoring packs documents into blocks. The distinct words of a block go out as 64-bit hashes to the
buckets of the vocabulary; their numbers and counts come back in the same order. Then each pair of words
goes to its restaurant's bucket, which counts, seats and scores it, and sums
by document come back. Two different words with equal 64-bit hashes would count as one.

Defined cases: null text is empty and consists of the end token; without training texts
every token is unknown and the score is that of the base; repeated rows are scored (and
counted) one by one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.session import stage

TOP = 512
SWEEPS, BURN_IN, SEED = 14, 6, 11
STRENGTH = 1.0
UNSEEN = 0.5
#: Words whose counts a task holds before it hands them on.
HELD = 300_000
#: Tokens in a block that is scored together, and vocabulary entries in a bucket.
BLOCK_TOKENS = 1_000_000
BUCKET_WORDS = 50_000
LEAST_BUCKETS = 1024
#: Restaurants of a frequent word for the rare words after it, and training tokens in a bucket of restaurants.
SLICES = 64
SEATED = 2_000_000
LEAST_SEATINGS = 16
#: Stands for every word that training texts lack.
UNKNOWN = np.iinfo(np.int32).min
#: No word holds a blank, so the end token's spelling is its own.
END = b" "


def _hash(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(h, c): hashed tokens of ``docs`` (text) and their counts, the end token included."""

    def run(batches):
        from collections import Counter

        got: Counter = Counter()
        ends = 0

        def rows():
            words = [*got]
            return pa.RecordBatch.from_arrays([pa.array(_hash(words)), pa.array([*got.values()], pa.int64())], ["h", "c"])

        for batch in batches:
            for text in batch.column(0):
                got.update(_tokens(text.as_py()))
                ends += 1
                if len(got) > HELD:
                    yield rows()
                    got.clear()
        if ends:
            got[END] = ends
            yield rows()

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Classes:
    """Class numbers of tokens: 0 for the end, ``rest`` for all outside the table."""

    def __init__(self, top: list[int]):
        end = int(_hash([END])[0])
        self.numbers = {h: k for k, h in enumerate([end, *(h for h in top if h != end)])}
        self.rest = len(self.numbers)
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        """Number of each word; ``rest`` for a word of the shared class."""
        if len(self.known) > HELD:
            self.known = {w: k for w, k in self.known.items() if k != self.rest}
        try:
            return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = [w for w in set(words) if w not in self.known]
            get = self.numbers.get
            for w, h in zip(new, _hash(new).tolist()):
                self.known[w] = get(h, self.rest)
            return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def pair_counts(docs: DataFrame, classes: Classes) -> np.ndarray:
    """Counts of (class before, class) over all of ``docs`` (text); a text starts after an end."""
    size = classes.rest + 1

    def run(batches):
        total, cells, held = np.zeros(size * size, np.int64), [np.zeros(0, np.int64)], 0
        for batch in batches:
            for text in batch.column(0):
                k = np.concatenate([[0], classes.of(_tokens(text.as_py())), [0]])
                cells.append(k[:-1] * size + k[1:])
                held += len(k)
                if held > size * size:
                    total += np.bincount(np.concatenate(cells), minlength=size * size)
                    cells, held = [], 0
        total += np.bincount(np.concatenate(cells), minlength=size * size) if cells else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["cell", "n"])

    out = np.zeros(size * size, np.int64)
    for r in docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.cell] = r.n
    return out.reshape(size, size)


def seat(rng, customers: np.ndarray, open_weight: np.ndarray, discount: float) -> np.ndarray:
    """Tables of each dish when its customers enter one by one.

    A customer opens a table with weight ``open_weight`` against the customers seated
    less ``discount`` a table. Past the first eight, an eighth as many as are seated
    enter at a time under the same odds.
    """
    n = np.minimum(customers, 1).astype(np.float64)
    tables = n.copy()
    live = np.flatnonzero(customers > 1)
    while len(live):
        step = np.minimum(np.maximum(1, n[live] // 8), customers[live] - n[live])
        odds = open_weight[live] / (open_weight[live] + n[live] - discount * tables[live])
        tables[live] += rng.binomial(step.astype(np.int64), odds)
        n[live] += step
        live = live[n[live] < customers[live]]
    return tables


def discount_of(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones + twos > 0 else 0.5


def class_model(pairs: np.ndarray) -> np.ndarray:
    """Averaged predictive probabilities P(class | class before), rows sum to one."""
    rng, size = np.random.default_rng(SEED), len(pairs)
    u, w = np.nonzero(pairs)
    c = pairs[u, w]
    d, d0 = discount_of((c == 1).sum(), (c == 2).sum()), 0.5
    totals = pairs.sum(1).astype(np.float64)
    tables = np.minimum(c, 1).astype(np.float64)
    out = np.zeros((size, size))
    for sweep in range(SWEEPS):
        upper = np.bincount(w, tables, size)  # the parent's customers are its children's tables
        own = seat(rng, upper, np.full(size, (STRENGTH + d0 * np.count_nonzero(upper)) / size), d0)
        parent = (upper - d0 * own + (STRENGTH + d0 * own.sum()) / size) / (STRENGTH + upper.sum())
        opened = np.bincount(u, tables, size)
        tables = seat(rng, c, (STRENGTH + d * opened[u]) * parent[w], d)
        if sweep >= BURN_IN:
            opened = np.bincount(u, tables, size)
            p = (STRENGTH + d * opened)[:, None] * parent[None, :]
            p[u, w] += c - d * tables
            out += p / (STRENGTH + totals)[:, None]
    return out / (SWEEPS - BURN_IN)


class WordModel:
    """P(word | shared class) by the word's count; ``table`` rows: count, words with it."""

    def __init__(self, table: np.ndarray):
        rng = np.random.default_rng(SEED + 1)
        c, words = table[:, 0].astype(np.int64), table[:, 1].astype(np.float64)
        total, kinds = float((c * words).sum()), float(words.sum())
        n = dict(zip(c.tolist(), words.tolist()))
        d = discount_of(n.get(1, 0), n.get(2, 0))
        known = (1 - UNSEEN) / max(1.0, kinds)
        draws = 32
        mean = np.minimum(c, 1).astype(np.float64)
        seen, p_unseen, p_known = np.zeros(len(c)), 0.0, 0.0
        for sweep in range(SWEEPS):
            opened = float((mean * words).sum())
            weight = (STRENGTH + d * opened) * known
            mean = seat(rng, np.repeat(c, draws), np.full(len(c) * draws, weight), d).reshape(-1, draws).mean(1)
            if sweep >= BURN_IN:
                new = STRENGTH + d * float((mean * words).sum())
                seen += (c - d * mean) / (STRENGTH + total)
                p_known += new * known / (STRENGTH + total)
                p_unseen += new * UNSEEN / (STRENGTH + total)
        k = SWEEPS - BURN_IN
        self.counts, self.p = np.append(0, c), np.append(p_unseen / k if kinds else 1.0, (seen + p_known) / k)

    def log10(self, c: np.ndarray) -> np.ndarray:
        return np.log10(self.p[np.searchsorted(self.counts, c)])


BLOCKS = "block long, bucket int, tag int, a binary, b binary, c binary"
_BLOCKS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("tag", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _BLOCKS)], schema=_BLOCKS)


def _packed(x: np.ndarray) -> bytes:
    """Rows of numbers in about half the room: all their lowest bytes, then the next ones and so on, each compressed by itself."""
    width = x.itemsize * int(np.prod(x.shape[1:]))
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), width).T)
    parts = [pa.compress(p, codec="zstd", asbytes=True) if p.any() else b"" for p in planes]
    return np.array([len(x), *map(len, parts)], np.int32).tobytes() + b"".join(parts)


def _unpacked(x: bytes, number, columns: int = 1) -> np.ndarray:
    """The columns of what was packed, as rows."""
    width = np.dtype(number).itemsize * columns
    n, *sizes = np.frombuffer(x, np.int32, width + 1).tolist()
    out, at = np.zeros((n, width), np.uint8), 4 * (width + 1)
    for k, size in enumerate(sizes):
        if size:
            out[:, k] = np.frombuffer(pa.decompress(memoryview(x)[at : at + size], decompressed_size=n, codec="zstd"), np.uint8)
        at += size
    return np.ascontiguousarray(out.view(number).T)


def _runs(x: np.ndarray):
    """(start, end) of each run of equal values."""
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else []
    return zip(starts, [*starts[1:], len(x)])


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = got = len(self)
        return got


def blocks(docs: DataFrame, classes: Classes, buckets: int) -> DataFrame:
    """Documents (doc_id, text, train, scored) as blocks. Tag 0: a: doc ids, b: tokens, null id, train and
    scored of each, c: numbers of the words in order. Tag 1, one a bucket: a: hashes of words
    of the shared class, which have numbers in a row, b: the first; in bucket -1 are the other words, which come first, c: their classes."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        numbers, ids, meta, words, held = Numbers(), [], [], [], 0

        def flush():
            h = _hash([*numbers])
            k = np.fromiter((classes.numbers.get(x, classes.rest) for x in h.tolist()), np.int32, len(h))
            slot = np.where(k == classes.rest, (h.view(np.uint64) % np.uint64(buckets)).astype(np.int32), -1)
            by = np.lexsort((h, slot))
            number = np.empty(len(h), np.int32)
            number[by] = np.arange(len(h))
            h, k, slot = h[by], k[by], slot[by]
            top = int(np.searchsorted(slot, 0))
            rows = [
                (block, -1, 0, np.array(ids, np.int64).tobytes(), np.array(meta, np.int32).tobytes(), _packed(number[np.concatenate(words)])),
                (block, -1, 1, None, np.int32(0).tobytes(), k[:top].tobytes()),
            ]
            rows.extend((block, int(slot[top + s]), 1, h[top + s : top + e].tobytes(), np.int32(top + s).tobytes(), None) for s, e in _runs(slot[top:]))
            return _record(rows)

        for batch in batches:
            for doc_id, text, train, scored in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                tokens = _tokens(text.as_py())
                words.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
                ids.append(0 if doc_id is None else doc_id)
                meta.append((len(tokens), doc_id is None, train, scored))
                held += len(tokens) + 1
                if held >= BLOCK_TOKENS:
                    yield flush()
                    block += 1
                    numbers, ids, meta, words, held = Numbers(), [], [], [], 0
        if ids:
            yield flush()

    return docs.mapInArrow(run, BLOCKS)


def slot_of(buckets: int):
    """Bucket of ``h``, taken as unsigned: the signed remainder, moved into range by what the top bit is worth."""
    top = (1 << 64) % buckets
    return F.pmod(F.when(F.col("h") < 0, F.pmod("h", F.lit(buckets)) + top).otherwise(F.pmod("h", F.lit(buckets))), F.lit(buckets)).cast("int")


def packed_vocabulary(vocab: DataFrame, buckets: int) -> DataFrame:
    """Vocabulary rows (h, c) as one block a bucket, tag 0: a: ascending hashes, b: counts."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            h, c = t.column("h").to_numpy(), t.column("c").to_numpy()
            by = np.argsort(h)
            return _record([(0, int(t.column("bucket")[0].as_py()), 0, h[by].tobytes(), c[by].tobytes(), None)])

        for batch in batches:
            slot = batch.column(0).to_numpy()
            for s, e in _runs(slot):
                if held and held[0].column(0)[0].as_py() != slot[s]:
                    yield flush()
                    held.clear()
                held.append(batch.slice(s, e - s))
        if held:
            yield flush()

    keyed = vocab.select(slot_of(buckets).alias("bucket"), "h", "c").repartition("bucket").sortWithinPartitions("bucket")
    return keyed.mapInArrow(run, BLOCKS)


def _answer(buckets: int, number: str):
    def run(batches):
        """Rows sorted by (bucket, tag): each block's hashes, tag 1, become the places of the words and their counts, tag 2."""
        bucket, h, c, place = None, None, None, None
        for batch in batches:
            rows = []
            for block, b, tag, x, y, _ in zip(*(col.to_pylist() for col in batch.columns)):
                if tag == 0:
                    bucket, h, c = b, np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                    # Frequent words get small numbers, which pack well.
                    place = np.empty(len(h), np.int64)
                    place[np.argsort(-c, kind="stable")] = np.arange(len(h))
                    continue
                asked = np.frombuffer(x, np.int64)
                at = found = np.zeros(len(asked), np.int64)
                if bucket == b and len(h):
                    at = np.minimum(np.searchsorted(h, asked), len(h) - 1)
                    found, at = np.where(h[at] == asked, c[at], 0), place[at]
                rows.append((block, b, 2, _packed(np.column_stack([at, found]).astype(number)), None, None))
            if rows:
                yield _record(rows)

    return run


def _pairs(classes: Classes, inside: np.ndarray, logp: np.ndarray, model: WordModel, mass: float, seatings: int, buckets: int, number: str):
    """Blocks with their words' answers become, a block, one row of documents, tag 0, with what needs no restaurant
    of a word, and rows of word pairs for the buckets of restaurants, tag 1: a: contexts,
    words and their counts, c: documents, doubled, and one more in training texts."""
    rest = classes.rest

    def block_rows(block, docs, meta, words, told):
        size = max(at + len(x) for at, x, _ in told)
        # The end token follows the numbered words.
        k, ids, counts = np.full(size + 1, rest), np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        k[size], counts[size] = 0, inside[0]
        for first, x, y in told:
            at = slice(first, first + len(x))
            if y is None:
                k[at], counts[at] = x, inside[x]
            else:
                ids[at], counts[at] = x, y
        w = np.full(len(words) + len(docs), size)
        ends = np.cumsum(meta[:, 0] + 1) - 1
        inner = np.ones(len(w), bool)
        inner[ends] = False
        w[inner] = words
        u = np.append(size, w[:-1])
        of = np.repeat(np.arange(len(docs)), meta[:, 0] + 1)
        base = np.bincount(of, (np.log10(counts + 0.1) - mass)[w], len(docs))
        known = np.bincount(of, (counts > 0)[w], len(docs)).astype(np.int64)
        single = np.where(k == rest, model.log10(np.where(k == rest, counts, 0)), 0.0)
        frequent = k[u] != rest
        asked = np.where(frequent, (k[w] == rest) & (counts[w] > 0), counts[u] > 0)
        own = np.where(asked & ~frequent, 0.0, logp[k[u], k[w]]) + np.where(asked, 0.0, single[w])
        about = np.column_stack([meta[:, 0] + 1, known, meta[:, 1], meta[:, 3]]).astype(np.int64)
        rows = [(block, block % seatings, 0, docs.tobytes(), about.tobytes(), np.column_stack([base, np.bincount(of, own, len(docs))]).tobytes())]
        u, w, of, frequent = u[asked], w[asked], of[asked], frequent[asked]
        table = np.where(frequent, -1 - (k[u] * SLICES + ids[w] % SLICES), ids[u]).astype(number)
        dish = np.where(k[w] != rest, -1 - k[w], np.where(counts[w] > 0, ids[w], UNKNOWN)).astype(number)
        slot = ((table.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(seatings)).astype(np.uint16 if seatings < 1 << 16 else np.int64)
        by = np.argsort(slot, kind="stable")
        # The slice of a frequent word's restaurant follows from the word.
        asks = np.column_stack([np.where(frequent, -1 - k[u], table), dish, counts[w]]).astype(number)[by]
        slot, of = slot[by], of[by]
        of = (2 * of + meta[of, 2]).astype(np.int32)
        for s, e in _runs(slot):
            rows.append((block, int(slot[s]), 1, _packed(asks[s:e]), None, _packed(of[s:e])))
        return _record(rows)

    def run(batches):
        block, docs, meta, words, asked, told = None, None, None, None, {}, []
        for batch in batches:
            for b, bucket, tag, x, y, z in zip(*(col.to_pylist() for col in batch.columns)):
                if b != block:
                    if block is not None:
                        yield block_rows(block, docs, meta, words, told)
                    block, asked, told = b, {}, []
                if tag == 0:
                    docs, meta, words = np.frombuffer(x, np.int64), np.frombuffer(y, np.int32).reshape(-1, 4), _unpacked(z, np.int32)[0]
                elif tag == 1 and bucket < 0:
                    told.append((0, np.frombuffer(z, np.int32), None))
                elif tag == 1:
                    asked[bucket] = int(np.frombuffer(y, np.int32)[0])
                else:
                    at, count = _unpacked(x, number, 2)
                    told.append((asked.pop(bucket), at.astype(np.int64) * buckets + bucket, count))
        if block is not None:
            yield block_rows(block, docs, meta, words, told)

    return run


def seated(rng, tables_of: np.ndarray, customers: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Averaged predictive probabilities of dishes in restaurants; rows: restaurant, customers and
    the parent's probability of each dish. A dish without customers may stand for words never served."""
    size = int(tables_of.max()) + 1 if len(tables_of) else 0
    d = discount_of((customers == 1).sum(), (customers == 2).sum())
    totals = STRENGTH + np.bincount(tables_of, customers, size)[tables_of]
    many = np.flatnonzero(customers > 1)
    tables, out = np.minimum(customers, 1).astype(np.float64), np.zeros(len(customers))
    for sweep in range(SWEEPS):
        opened = STRENGTH + d * np.bincount(tables_of, tables, size)
        tables[many] = seat(rng, customers[many], opened[tables_of[many]] * parent[many], d)
        if sweep >= BURN_IN:
            opened = STRENGTH + d * np.bincount(tables_of, tables, size)
            out += (customers - d * tables + opened[tables_of] * parent) / totals
    return out / (SWEEPS - BURN_IN)


def _restaurants(classes: Classes, logp: np.ndarray, model: WordModel, shares: np.ndarray, number: str):
    """Rows sorted by bucket: word pairs, tag 1, become sums of their log10 probabilities by document; others pass."""

    def bucket_rows(bucket, held):
        table, dish, count, of = (np.concatenate(x) for x in list(zip(*held))[1:])
        table = np.where(table < 0, -1 - ((-1 - table) * SLICES + dish % SLICES), table)
        by = np.lexsort((dish, table))
        table, dish = table[by], dish[by]
        new_table = np.append(True, table[1:] != table[:-1])
        new = new_table | np.append(True, dish[1:] != dish[:-1])
        pair = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        customers = np.bincount(pair, of[by] & 1).astype(np.int64)
        table, dish, count = table[first].astype(np.int64), dish[first].astype(np.int64), count[by][first].astype(np.int64)
        rare = (dish >= 0) | (dish == UNKNOWN)
        single = np.where(rare, model.log10(np.where(rare, count, 0)), 0.0)
        share = np.where(table < 0, shares[np.where(table < 0, -1 - table, 0) % SLICES], 1.0)
        parent = 10 ** (single + np.where(table < 0, 0.0, logp[classes.rest, np.where(rare, classes.rest, -1 - dish)])) / share
        got = np.empty(len(pair))
        got[by] = np.log10(seated(np.random.default_rng([SEED, bucket]), np.cumsum(new_table)[first] - 1, customers, parent) * share)[pair]
        rows, at = [], 0
        for block, t, *_ in held:
            doc = of[at : at + len(t)] >> 1
            starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            rows.append((block, bucket, 1, _packed(doc[starts]), np.add.reduceat(got[at : at + len(t)], starts).tobytes(), None))
            at += len(t)
        return _record(rows)

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            rows = []
            for row in zip(*(col.to_pylist() for col in batch.columns)):
                block, b, tag, x, y, z = row
                if tag == 0:
                    rows.append(row)
                    continue
                if b != bucket:
                    if held:
                        yield bucket_rows(bucket, held)
                    bucket, held = b, []
                held.append((block, *_unpacked(x, number, 3), _unpacked(z, np.int32)[0]))
            if rows:
                yield _record(rows)
        if held:
            yield bucket_rows(bucket, held)

    return run


def _score_rows(batches):
    """Rows sorted by (block, tag): documents, tag 0, and what their word pairs add, tag 1."""
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    block, docs, about, sums = None, None, None, None

    def rows():
        some = np.flatnonzero(about[:, 3])
        d, a, s = docs[some], about[some], sums[some]
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64(), mask=a[:, 2].astype(bool)), pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(s[:, 0]), pa.array(s[:, 1])], names)

    for batch in batches:
        for b, _, tag, x, y, z in zip(*(col.to_pylist() for col in batch.columns)):
            if b != block:
                if block is not None:
                    yield rows()
                block = b
            if tag == 0:
                docs, about, sums = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64).reshape(-1, 4), np.frombuffer(z, np.float64).reshape(-1, 2).copy()
            else:
                sums[_unpacked(x, np.int32)[0], 1] += np.frombuffer(y, np.float64)
    if block is not None:
        yield rows()


def slice_shares(rare: DataFrame, model: WordModel, buckets: int) -> np.ndarray:
    """Probability within the shared class of the known words (h, c) of each slice."""

    def run(batches):
        for batch in batches:
            p = 10 ** model.log10(batch.column(1).to_numpy()) * batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["slice", "p"])

    counts = rare.groupBy((slot_of(buckets) % SLICES).alias("slice"), "c").agg(F.count("*").alias("n"))
    out = np.zeros(SLICES)
    for r in counts.mapInArrow(run, "slice int, p double").groupBy("slice").agg(F.sum("p").alias("p")).collect():
        out[r.slice] = r.p
    return out


def scores(docs: DataFrame, train: DataFrame | Column, top: int = TOP) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``,
    with a model of all texts of ``train``, or of the rows of ``docs`` where the condition ``train`` holds."""
    if isinstance(train, DataFrame):
        texts = train.select("text")
        read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("train"), F.lit(True).alias("scored"))
        read = read.union(train.select(F.lit(None).cast("long"), "text", F.lit(True), F.lit(False)))
    else:
        texts = docs.where(train).select("text")
        read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"), F.lit(True).alias("scored"))
    vocab = stage(vocabulary(texts), "vocabulary")
    row = vocab.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    best = vocab.orderBy(F.desc("c"), "h").limit(top).collect()
    classes = Classes([r.h for r in best])
    end = int(_hash([END])[0])
    counts = {r.h: r.c for r in best}
    if end not in counts:
        counts[end] = sum(r.c for r in vocab.where(F.col("h") == end).collect())
    inside = np.array([counts[h] for h in classes.numbers], np.int64)
    mass = float(np.log10(row.n + 0.1 * (row.v + 1)))
    rare = vocab.where(~F.col("h").isin([*classes.numbers]))
    by_count = np.array([(r.c, r.n) for r in rare.groupBy("c").agg(F.count("*").alias("n")).orderBy("c").collect()], np.float64).reshape(-1, 2)
    logp = np.log10(class_model(pair_counts(texts, classes)))
    model = WordModel(by_count)
    buckets = -(-max(LEAST_BUCKETS, -(-row.v // BUCKET_WORDS)) // SLICES) * SLICES
    seatings = max(LEAST_SEATINGS, -(-row.n // SEATED))
    # Numbers of words are places in their buckets, which are about equal, times the buckets.
    number = "<i4" if row.v < 1 << 29 else "<i8"
    sent = stage(blocks(read, classes, buckets), "blocks")
    asked = sent.where("tag = 1 and bucket >= 0").withColumn("b", F.lit(None).cast("binary"))
    told = packed_vocabulary(rare, buckets).union(asked).repartition("bucket").sortWithinPartitions("bucket", "tag").mapInArrow(_answer(buckets, number), BLOCKS)
    kept = sent.withColumn("a", F.when(F.col("tag") == 0, F.col("a")))
    paired = kept.union(told).repartition("block").sortWithinPartitions("block", "tag").mapInArrow(_pairs(classes, inside, logp, model, mass, seatings, buckets, number), BLOCKS)
    summed = paired.repartition(seatings, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(_restaurants(classes, logp, model, slice_shares(rare, model, buckets), number), BLOCKS)
    out = summed.repartition("block").sortWithinPartitions("block", "tag").mapInArrow(_score_rows, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(row.n).cast("long"))
