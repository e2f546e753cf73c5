"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: byte trigrams of the text as it is,
single words and pairs of neighbouring words in lower case, and runs of two,
three and four equal words, whatever the word.  An indicator is
scaled by its class log-count ratio, a text by the length of its vector, and a
linear hinge-loss model is fitted by dual coordinate descent.  A logistic curve
through the margins of a held-back quarter of the sample turns margins into
probabilities.

The fit uses a sample of at most ``SAMPLE_ROWS`` labelled rows, those with the
smallest hash of their ``doc_id``: the sample, its features and the fit are
bounded whatever the size of the tables.  Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _WORD_HASHES, mix, raw_texts, slices

SAMPLE_ROWS = 8000
BITS = 18
THRESHOLD = 0.3
COST = 1.0
EPOCHS = 20

_HALF = 1 << (BITS - 1)
#: runs of equal words stand behind the hashed features
_RUNS = (2, 3, 4)
SIZE = (1 << BITS) + len(_RUNS)


def features(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted numbers of the features that occur in each text."""
    seen = np.zeros(SIZE, bool)
    shift = np.uint64(64 - BITS + 1)
    for text in texts:
        raw = np.frombuffer(text, np.uint8).astype(np.uint32)
        if len(raw) > 2:
            code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
            seen[(code * np.uint32(2654435761)) >> np.uint32(32 - BITS + 1)] = True
        words = text.lower().split()
        if words:
            h = np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))
            seen[_HALF + (h >> shift).astype(np.int64)] = True
            seen[_HALF + (mix(h[:-1] * np.uint64(3) + h[1:]) >> shift).astype(np.int64)] = True
            same = h[1:] == h[:-1]
            for k in range(len(_RUNS)):
                if not same.any():
                    break
                seen[(1 << BITS) + k] = True
                same = same[1:] & same[:-1]
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


class Model:
    """Feature weights, bias and the curve from margin to probability."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.ratios, self.bias, self.slope, self.shift = ratios, bias, slope, shift
        self.scaled = (weights * ratios).astype(np.float32)
        self.squares = (ratios * ratios).astype(np.float32)

    def margin(self, found: np.ndarray) -> float:
        norm = float(self.squares[found].sum()) ** 0.5
        return self.bias + (float(self.scaled[found].sum()) / norm if norm else 0.0)

    def score(self, found: np.ndarray) -> float:
        z = np.clip(self.slope * self.margin(found) + self.shift, -500, 500)
        return float(1 / (1 + np.exp(-z)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.ones((2, SIZE))
    for found, label in zip(rows, labels.tolist()):
        counts[label, found] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray,
                 cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and bias; one dual variable per row, updated in a fixed random order."""
    weights, bias = np.zeros(SIZE), 0.0
    alpha = np.zeros(len(rows))
    diagonal = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            idx, v, y = rows[i], values[i], signs[i]
            gradient = y * (weights[idx] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost)
            step = (new - alpha[i]) * y
            if step:
                weights[idx] += step * v
                bias += step
                largest = max(largest, abs(step))
                alpha[i] = new
        if largest < 1e-3 * cost:
            break
    return weights, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic curve through margins, by Newton steps on smoothed targets."""
    pos, neg = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        error, w = p - target, np.maximum(p * (1 - p), 1e-12)
        g = np.array([error @ margins, error.sum()])
        h = np.array([[w @ (margins * margins) + 1e-6, w @ margins], [w @ margins, w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on three quarters of the rows, calibrate on the rest; one class alone gives its smoothed share."""
    labels = labels.astype(np.int64)
    cut = len(rows) - len(rows) // 4
    if len(set(labels[:cut].tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        zero = np.zeros(SIZE)
        return Model(zero, zero, 0.0, 0.0, float(np.log(share / (1 - share))))
    ratios = log_count_ratios(rows[:cut], labels[:cut])
    values = []
    for found in rows[:cut]:
        v = ratios[found]
        norm = float(np.sqrt(v @ v))
        values.append(v / norm if norm else v)
    weights, bias = dual_descent(rows[:cut], values, 2.0 * labels[:cut] - 1)
    model = Model(ratios, weights, bias, 1.0, 0.0)
    held = slice(cut, None) if cut < len(rows) else slice(None)
    model.slope, model.shift = calibrate(np.array([model.margin(f) for f in rows[held]]), labels[held])
    return model


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            lists = [f.astype("<i4").tobytes() for f in features(raw_texts(batch.column("text")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_order"), batch.column("label"), pa.array(lists, pa.binary())],
                names=["_order", "label", "features"])


def train(docs: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on ``labelled`` (``doc_id``, ``label`` 0 or 1) joined to the texts of ``docs``.

    At most ``sample_rows`` rows are taken, so the list of their ids, which is
    broadcast, and their features, which reach the driver, are bounded.  Rows
    without id or label, or with another label, are passed over.
    """
    order = F.xxhash64("doc_id")
    chosen = (
        labelled.where("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("label").cast("int")).alias("label"))
        .withColumn("_order", order).orderBy("_order", "doc_id").limit(sample_rows)
    )
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("_order", "label", "text").mapInArrow(
        _featurise, "_order long, label int, features binary").toArrow().sort_by("_order")
    found = [np.frombuffer(b, "<i4") for b in rows.column("features").to_pylist()][:sample_rows]
    return fit(found, rows.column("label").to_numpy()[:sample_rows])


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                scores = [fitted.score(f) for f in features(raw_texts(batch.column("text")))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) of every row.

    NULL texts count as empty; an empty text gets the score of the bias alone.
    Repeated rows are each scored; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _scored(shared), "doc_id long, score double"
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out() -> Column:
    """The fifth of the documents that no label is learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0
