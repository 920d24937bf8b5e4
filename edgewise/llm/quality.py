"""Quality classifier: random Fourier features, ridge normal equations, isotonic calibration.

Each text becomes a row of plain statistics. Random Fourier features of the standardised
statistics approximate a Gaussian kernel. Each partition of labelled rows sums its part
of the normal equations; the parts are added and solved once, in a size that does not
depend on the data. Rows set aside from the fit calibrate the ridge value by isotonic
regression over fixed bins.

Defined cases: null text is empty text; empty texts are scored like others; a document
with several labels counts with their mean; null labels are left out; without labels,
or with one class alone, the score is the mean label (0.5 without any); repeated rows
are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.session import stage

FEATURES = 192
GAMMA = 0.01
RIDGE = 1e-3
BINS = 2048
SEED = 7

_CLASS = np.zeros((256, 11))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?'\"()-", b"!", b"#*$%&", b"|<>")):
    _CLASS[list(_chars), _k] = 1
_CLASS[128:, 9] = 1
_CLASS[:, 10] = 1 - _CLASS.sum(1).clip(0, 1)
STATISTICS = 11 + 12


def statistics(text: str) -> list[float]:
    """The statistics of one whole text."""
    raw = text.encode()
    n = max(1, len(raw))
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / n
    words = raw.split()
    k = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = max(1, len(words) - 2)
    again = sum(map(bytes.__eq__, words, words[1:]))
    return [
        *share.tolist(),
        float(np.log1p(len(raw))), float(np.log1p(len(words))), float(np.log1p(len(lines))),
        float(sizes.mean()), float(sizes.std()), float((sizes <= 3).mean()), float((sizes >= 12).mean()),
        len(set(words)) / k, len(set(zip(words, words[1:], words[2:]))) / triples, again / k,
        1 - len(set(lines)) / max(1, len(lines)), max(map(len, lines), default=0) / n,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<float>) for each row; one narrow pass."""

    def run(batches):
        kind = pa.list_(pa.float32())
        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, kind)], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<float>")


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


class Model:
    """Standardisation, random directions, ridge weights and the calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(scale=np.sqrt(2 * GAMMA), size=(len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.curve = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        raw, (_, levels) = self.raw(x), self.curve
        if levels.min() == levels.max():
            return np.full(len(x), levels[0])
        # A little of the ridge value keeps order among equal calibrated values.
        return np.clip(0.999 * np.interp(raw, *self.curve) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def isotonic(at: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins with a weight and a sum of labels; block means at block centres."""
    blocks: list[list[float]] = []
    for x, w, t in zip(at, weight, total):
        blocks.append([x * w, w, t])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(labelled: DataFrame) -> Model:
    """A model from ``labelled`` (x, y double, calibrate boolean); no bound on its rows.

    The mean and spread, the normal equations and the calibration bins are sums over
    all labelled rows; only these sums, of fixed size, reach the driver.
    """
    width = STATISTICS
    sums = [F.sum(F.when(~F.col("calibrate"), F.lit(1.0)).otherwise(0.0)).alias("n"), F.avg("y").alias("base"), F.min("y").alias("lo"), F.max("y").alias("hi")]
    sums += [f(F.col("x")[k].cast("double")).alias(f"{n}{k}") for k in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = labelled.agg(*sums).first()
    if row["base"] is None or row["lo"] == row["hi"]:
        model = Model(np.zeros(width), np.ones(width))
        base = 0.5 if row["base"] is None else row["base"]
        model.curve = (np.array([0.0, 1.0]), np.array([base, base]))
        return model
    spread = np.array([row[f"s{k}"] for k in range(width)])
    model = Model(np.array([row[f"m{k}"] for k in range(width)]), np.where(spread > 1e-9, spread, 1.0))
    size = FEATURES + 2

    def normal(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                z = np.hstack([model.features(_matrix(batch, "x")), batch.column("y").to_numpy()[:, None]])
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "v"])

    # Too few rows to set any aside: calibrate on the rows of the fit.
    apart = row["n"] >= 200
    used = labelled.where(~F.col("calibrate")) if apart else labelled
    parts = used.select("x", "y").mapInArrow(normal, "i int, v array<double>")
    cells = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((size, size))
    for c in cells:
        total[c.i, c.j] = c.v
    gram, right = total[:-1, :-1], total[:-1, -1]
    model.beta = np.linalg.solve(gram + RIDGE * total[-2, -2] / FEATURES * np.eye(size - 1), right)

    def bins(batches):
        weight, label = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if batch.num_rows:
                at = np.clip((model.raw(_matrix(batch, "x")) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
                weight += np.bincount(at, minlength=BINS)
                label += np.bincount(at, batch.column("y").to_numpy(), BINS)
        k = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(weight[k]), pa.array(label[k])], ["bin", "w", "t"])

    held = labelled.where("calibrate") if apart else labelled
    found = held.select("x", "y").mapInArrow(bins, "bin int, w double, t double").groupBy("bin").agg(F.sum("w").alias("w"), F.sum("t").alias("t")).orderBy("bin").collect()
    if found:
        at = (np.array([r.bin for r in found]) + 0.5) / BINS * 2 - 0.5
        model.curve = isotonic(at, np.array([r.w for r in found]), np.array([r.t for r in found]))
    return model


def with_labels(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the documents that ``labels`` (doc_id, quality) marks; a fifth is for calibration."""
    mark = labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    return stats.join(mark, "doc_id").select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("calibrate"))


def scores(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of statistics."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = model.score(_matrix(batch, "x"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) marks."""
    marked = labels.where("quality is not null").select("doc_id").distinct()
    stats = stage(document_statistics(docs.select("doc_id", "text").join(marked, "doc_id", "left_semi")), "labelled-statistics")
    return fit(with_labels(stats, labels))


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text scores at least ``least``; a narrow pass."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t.as_py() or "") for t in batch.column(at)], np.float32).astype(np.float64)
                yield batch.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of every row of ``docs``, learnt from ``labels`` (doc_id, quality)."""
    stats = stage(document_statistics(docs), "statistics")
    return scores(stats, fit(with_labels(stats, labels)))
