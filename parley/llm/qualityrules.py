"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from one vectorised pass over the bytes of a chunk of texts.  The trees are fitted on a
bounded, documented sample of labelled rows that aren't held out, then flattened into node arrays and
scored for a whole batch at a time.  Some statistics are constrained: more of them never raises a score.

Defined cases: null or empty text has no words and fails the base rule; without labels of both kinds
there are no trees and the base rule alone decides; repeated rows each get their row, and what an id that
repeats teaches is in labelled_sample; extra columns, whatever their names, are not read; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import chunks, labelled_sample, lean, table
from parley.llm.textkernel import CODES, SPACE, U, mix, shingles, span_hashes, words

#: Labelled rows that the trees are fitted on, taken in the order of a hash of the id.
TRAIN_ROWS = 20_000
#: Documents of at least this score are kept, if they pass the base rule.
KEEP_FROM = 0.3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and the direction in which a score may go as they grow (0: either).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "upper": -1, "digits": 0, "marks": -1,
    "line_words": 0, "repeats_next": -1, "odd_words": -1
}


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many True bytes each text has."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text number) of the lines of each text, split at \\n."""
    ends = np.flatnonzero(data == 10)
    count = np.bincount(np.searchsorted(offsets, ends, "right") - 1, minlength=len(offsets) - 1) + 1
    starts = np.sort(np.concatenate([offsets[:-1], ends + 1]), kind="stable")
    return starts, np.sort(np.concatenate([ends, offsets[1:]]), kind="stable"), np.repeat(np.arange(len(offsets) - 1), count)


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, features) of each text of a chunk, a row per text."""
    n, codes = len(offsets) - 1, CODES[data]
    starts, ends, doc = words(data, offsets)
    inside = ~SPACE[data]
    n_words = np.bincount(doc, minlength=n)
    hashes = span_hashes(codes, starts, ends)
    salt = mix(np.arange(1, n + 1, dtype=U))

    line_start, line_end, line_doc = lines(data, offsets)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=filled[1:])
    real = filled[line_end] > filled[line_start]
    line_doc = line_doc[real]
    line_keys = mix(span_hashes(codes, line_start[real], line_end[real]) + salt[line_doc])
    first = np.zeros(len(line_keys), bool)
    first[np.unique(line_keys, return_index=True)[1]] = True
    n_lines = np.bincount(line_doc, minlength=n)
    dup_lines = n_lines - np.bincount(line_doc[first], minlength=n)

    covered = np.zeros(len(doc), bool)
    if len(doc) >= 3:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        keys = mix(shingles(hashes)[at] + salt[doc[at]])
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(keys), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for k in range(3):
            covered[at[again] + k] = True
    repeat_words = np.bincount(doc[covered], minlength=n)

    chars = per_text(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = per_text(SYMBOLS[data], offsets)
    base = np.stack([n_words, chars, symbols, dup_lines, repeat_words], 1)
    upper = per_text((data >= 65) & (data <= 90), offsets)
    digits = per_text((data >= 48) & (data <= 57), offsets)
    letter = LETTER[data]
    letters = per_text(letter, offsets)
    follow = np.zeros(len(doc), bool)
    follow[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    follow = np.bincount(doc[follow], minlength=n)
    bare = np.zeros(len(data) + 1, np.int64)
    np.cumsum(letter, out=bare[1:])
    odd = np.bincount(doc[bare[ends] == bare[starts]], minlength=n)
    w, c = np.maximum(n_words, 1), np.maximum(chars, 1)
    marks = per_text(inside, offsets) - letters - digits
    features = np.stack(
        [
            np.log1p(n_words), chars / w, symbols / w, dup_lines / np.maximum(n_lines, 1), repeat_words / w, upper / c,
            digits / c, marks / c, n_words / np.maximum(n_lines, 1), follow / w, odd / w
        ],
        1
    )
    return base, features


@dataclass(frozen=True)
class Trees:
    """Flattened trees: of each node its feature, threshold, children (a leaf's are itself) and value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(
    x: np.ndarray, y: np.ndarray, direction=tuple(FEATURES.values()), rounds: int = 60, depth: int = 3, rate: float = 0.2,
    bins: int = 64, ridge: float = 5.0
) -> Trees | None:
    """Boosted trees for a logistic loss, from histograms of gradients; None without both labels."""
    if len(y) == 0 or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    coded = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), bias)
    nodes: list[list] = []
    roots = []

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        g, h = gradient[rows], hessian[rows]
        value = float(np.clip(-g.sum() / (h.sum() + ridge), low, high))
        me = len(nodes)
        nodes.append([0, np.inf, me, me, value * rate])
        best = (1e-6, None)
        if level < depth and len(rows) >= 40:
            whole = g.sum() ** 2 / (h.sum() + ridge)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(coded[rows, j], g, len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(coded[rows, j], h, len(e) + 1))[:-1]
                gr, hr = g.sum() - gl, h.sum() - hl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole
                gain[(hl < 1) | (hr < 1) | (direction[j] * (vr - vl) < 0)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, float(vl[k]), float(vr[k])))
        if best[1]:
            j, k, vl, vr = best[1]
            mid, goes = (vl + vr) / 2, coded[rows, j] <= k
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[direction[j]]
            nodes[me][:2] = [j, float(edges[j][k])]
            nodes[me][2] = grow(rows[goes], level + 1, *bounds[0])
            nodes[me][3] = grow(rows[~goes], level + 1, *bounds[1])
        else:
            margin[rows] += value * rate
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    f, t, a, b, v = zip(*nodes, strict=True)
    return Trees(np.array(f), np.array(t), np.array(a), np.array(b), np.array(v), np.array(roots), depth, bias)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Fits the trees on at most `rows` labelled documents that aren't held out."""
    found = labelled_sample(docs, labels, "quality", rows).mapInArrow(lean(_training_rows), "doc_id long, x array<double>, y int"
    ).toArrow().sort_by("doc_id")
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, np.array(found.column("y").to_pylist(), float))


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            x = statistics(data, offsets)[1]
            own = (batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "quality"))
            ids, y = next(own).cast(pa.int64()), next(own).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(x), pa.list_(pa.float64())), y], ["doc_id", "x", "y"])


def score(docs: DataFrame, trees: Trees | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, the base counts, score (null without trees), base_failed and kept for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column("text")):
                base, x = statistics(data, offsets)
                failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
                p = np.ones(len(x)) if trees is None else trees.score(x)
                cols = [
                    batch.column("doc_id").slice(lo, hi - lo), *(pa.array(base[:, k]) for k in range(5)), pa.array(p),
                    pa.array(failed), pa.array(~failed & (p >= keep_from))
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *BASE, "score", "base_failed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in BASE) + ", score double, base_failed boolean, kept boolean"
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
