"""Quality classifier: support vectors over n-gram indicators scaled by naive Bayes log-count ratios.

Features of a text are hashed indicators (present or not) of word unigrams and bigrams and of one-,
two- and three-grams of word shapes.  A shape is the word's sequence of character classes with runs
collapsed, and one fixed shape stands for a word that equals the word before it.  Each indicator is
multiplied by its log-count ratio between the classes and divided by the root of the number of the
text's features; dual coordinate descent fits a linear model with a hinge loss, and a logistic curve
fitted on rows apart from those turns margins into scores.

Defined cases: null or empty text has no features and gets the score of margin 0; without labels of
both kinds every score is the share of label 1 (1 without labels); repeated rows each get their row, and what
an id that repeats teaches is in labelled_sample; extra columns, whatever their names, are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import chunks, filtered, held_out, labelled_sample, lean, table
from parley.llm.textkernel import CODES, LOWER, SPACE, U, mix, shingles, span_hashes, words

#: Labelled rows that the model is fitted on, taken in the order of a hash of the id.
TRAIN_ROWS = 6_000
BITS = 18
SIZE = 1 << BITS
THRESHOLD = 0.3
CLASSES = np.arange(256, dtype=np.uint8)
CLASSES[97:123] = 97
CLASSES[128:] = 97
CLASSES[65:91] = 65
CLASSES[48:58] = 48


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature), distinct and in order, of a chunk."""
    starts, ends, doc = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = span_hashes(CODES[LOWER[data]], starts, ends)
    kind = CLASSES[data]
    turns = ~SPACE[data]
    turns[1:] &= kind[1:] != kind[:-1]
    turns[starts] = True
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(turns, out=at[1:])
    shape = span_hashes(CODES[kind[turns]], at[starts], at[ends])
    shape[1:][(word[1:] == word[:-1]) & (doc[1:] == doc[:-1])] = U(1)
    found = []
    for k, (values, width) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3))):
        if len(values) >= width:
            inside = doc[: len(doc) - width + 1] == doc[width - 1 :]
            hashed = mix(shingles(values, width)[inside] + U(k + 1)) >> U(64 - BITS)
            found.append(doc[: len(doc) - width + 1][inside] << BITS | hashed.astype(np.int64))
    keys = np.sort(np.concatenate(found))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys >> BITS, keys & (SIZE - 1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        count = np.maximum(np.bincount(doc, minlength=n), 1)
        margin = np.bincount(doc, self.weights[feature], n) / np.sqrt(count) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def descend(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for hinge loss; row i is scale[rows[i]] / sqrt(len), and a constant 1."""
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    value = [scale[r] / np.sqrt(max(len(r), 1)) for r in rows]
    norm = np.array([v @ v + 1.0 for v in value])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ value[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if step := new - alpha[i]:
                alpha[i] = new
                w[rows[i]] += step * y[i] * value[i]
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the curve that fits labels 0 and 1 to margins, by Newton's method."""
    a, b, n1 = 1.0, 0.0, y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g, w = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (g * margin).sum() + 1e-3 * a, g.sum() + 1e-3 * b
        haa, hab, hbb = (w * margin**2).sum() + 1e-3, (w * margin).sum(), w.sum() + 1e-3
        det = haa * hbb - hab**2
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return max(a, 1e-3), b


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Of each feature the log of its share among label 1's features over that among label 0's, from counts plus one."""
    count = np.ones((2, SIZE))
    for r, label in zip(rows, labels, strict=True):
        count[int(label), r] += 1
    count /= count.sum(1, keepdims=True)
    return np.log(count[1] / count[0])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """rows: distinct feature ids of each text; labels 0 or 1.  Every fifth row only fits the curve."""
    share = float(labels.mean()) if len(labels) else 1.0
    if len(labels) < 10 or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share))))
    apart = np.arange(len(rows)) % 5 == 4
    if labels[~apart].min() == labels[~apart].max() or labels[apart].min() == labels[apart].max():
        apart[:] = False
    learn = [r for r, x in zip(rows, apart, strict=True) if not x]
    ratio = log_ratios(learn, labels[~apart])
    y = np.where(labels[~apart] > 0, 1.0, -1.0)
    cost = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    w, bias = descend(learn, ratio, y, cost)
    weights = w * ratio
    check = [r for r, x in zip(rows, apart if apart.any() else ~apart, strict=True) if x]
    margin = np.array([weights[r].sum() / np.sqrt(max(len(r), 1)) for r in check]) + bias
    return Model(weights, bias, *logistic(margin, labels[apart] if apart.any() else labels))


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            doc, feature = features(data, offsets)
            ends = np.searchsorted(doc, np.arange(hi - lo + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), lists, batch.column("quality").slice(lo, hi - lo).cast(pa.int32())],
                ["doc_id", "x", "y"]
            )


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits the model on at most `rows` labelled documents that aren't held out."""
    found = labelled_sample(docs, labels, "quality", rows).mapInArrow(lean(_training_rows), "doc_id long, x array<int>, y int").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    lists = found.column("x").combine_chunks()
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return fit([flat[at[i] : at[i + 1]] for i in order], found.column("y").to_numpy()[order].astype(float))


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """The score of each text of a column."""
    out = [model.score(*features(data, offsets), hi - lo) for lo, hi, data, offsets in chunks(column)]
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = scores(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all their columns, whose text scores `threshold` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda texts: scores(texts, shared.value) >= threshold)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
