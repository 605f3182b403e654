"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j) = logistic(threshold_j - w.x) with one weight vector for all grades and
ordered thresholds.  x is the mean over the words of a text of hashed features (the
word, its shape, whether it repeats the word before), so a score is a mean of looked-up
weights: one pass over the bytes, no vocabulary and no shuffle.

Fitting uses a bounded sample of labelled rows (``per_class`` rows per grade, texts up
to ``max_chars``); scoring reads every text whole.

Edge cases: null and empty texts have no features and score by the thresholds alone;
without labelled rows, or with one grade only, every text gets that grade (or 0) and
tail probability 1; repeated rows score alike; very long texts are scored whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import FIT_BYTES, MAX_CHARS, PER_CLASS, labelled_sample
from ._text import NOT_SPACE, chunks, mix, span_hashes, tidied, word_spans

BITS = 16
SCALE = 30.0  # of the mean features
_U = np.uint64
#: Classes of bytes for a word's shape: lower case, capitals, digits, other letters; signs stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B], _SHAPE[0x41:0x5B], _SHAPE[0x30:0x3A], _SHAPE[0x80:] = 1, 2, 3, 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features by word: three bins each, index of the first word of each document)."""
    s, e, first = word_spans(data, offsets, NOT_SPACE)
    if not len(s):
        return np.zeros((0, 3), np.int64), first
    word = span_hashes(data, s, e)
    shape = _SHAPE[data]
    change = np.ones(len(data), bool)
    change[1:] = shape[1:] != shape[:-1]
    change[s] = True
    # the shape without repeats: hash the changes only
    at = np.flatnonzero(change)
    kind = span_hashes(shape[at], np.searchsorted(at, s), np.searchsorted(at, e), 1)
    again = np.zeros(len(s), np.uint64)
    again[1:] = word[1:] == word[:-1]
    starts = first[:-1]
    again[starts[starts < len(s)]] = 0
    pick = lambda h: (mix(h) >> _U(64 - BITS)).astype(np.int64)
    return np.stack([pick(word), pick(kind ^ _U(0x5851F42D4C957F2D)), pick(again + _U(17))], axis=1), first


def means(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """w.x of every document."""
    bins, first = features(data, offsets)
    sums = np.concatenate([[0.0], np.cumsum(weights[bins].sum(1))])
    n = np.diff(first)
    return SCALE * (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)


@dataclass(frozen=True)
class OrdinalModel:
    grades: tuple[int, ...]
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > grades[j]) by document and j."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -60, 60)))


def _csr(texts: list[str]):
    column = pa.array(texts, pa.string())
    rows, cols, vals = [], [], []
    for at, _, data, offsets in chunks(None, column, FIT_BYTES):
        bins, first = features(data, offsets)
        n = np.diff(first)
        doc = np.repeat(np.arange(len(n)), n)
        key, count = np.unique(np.repeat(doc, 3) * (1 << BITS) + bins.reshape(-1), return_counts=True)
        d = key >> BITS
        rows.append((d + at).astype(np.int32))
        cols.append((key & ((1 << BITS) - 1)).astype(np.int32))
        vals.append((SCALE * count / n[d]).astype(np.float32))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def fit_ordinal(sample: list[tuple[int, str]], rounds: int = 120, rate: float = 0.1, l2: float = 1e-4) -> OrdinalModel:
    """Full-batch Adam on the mean log loss, classes weighted alike."""
    grades = tuple(sorted({y for y, _ in sample}))
    if len(grades) < 2:
        return OrdinalModel(grades or (0,), np.zeros(1 << BITS), np.zeros(0))
    y = np.array([grades.index(g) for g, _ in sample])
    row, col, val = _csr([t for _, t in sample])
    n, k = len(y), len(grades)
    share = np.bincount(y, minlength=k)
    weight = (n / (k * share))[y] / n
    w = np.zeros(1 << BITS)
    theta = np.concatenate([[-(k - 2) / 2], np.zeros(k - 2)])  # first threshold, logs of the gaps
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, theta)]
    for step in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        z = np.bincount(row, val * w[col], n)
        ends = np.concatenate([[-np.inf], cuts, [np.inf]])
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
        up, down = sig(ends[y + 1] - z), sig(ends[y] - z)
        p = np.maximum(up - down, 1e-12)
        gu, gd = up * (1 - up) / p, down * (1 - down) / p
        gz = weight * (gu - gd)  # derivative of -log p by z
        gw = np.bincount(col, val * gz[row], 1 << BITS) + l2 * w
        gcut = np.zeros(k + 1)
        np.add.at(gcut, y + 1, -weight * gu)
        np.add.at(gcut, y, weight * gd)
        gcut = gcut[1:-1]
        gtheta = np.concatenate([[gcut.sum()], np.cumsum(gcut[::-1])[::-1][1:] * np.exp(theta[1:])])
        for p_, g, (m, v) in zip((w, theta), (gw, gtheta), state, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel(grades, w, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, where=None) -> OrdinalModel:
    return fit_ordinal(labelled_sample(docs, labels, label_col, id_col, text_col, per_class, max_chars, where))


def score_quality(docs: DataFrame, fitted: OrdinalModel, grade: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, expected_grade, tail_probability (of ``grade`` or better; by default the highest), and the columns of ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # 2**BITS weights
    top = fitted.grades[-1] if grade is None else grade

    def run(batches):
        m = shared.value
        steps = np.diff(np.array(m.grades, float))
        below = [j for j, g in enumerate(m.grades[:-1]) if g < top]
        for batch in batches:
            expected, tail = [], []
            for _, _, data, offsets in chunks(None, batch.column(1)):
                t = m.tails(means(m.weights, data, offsets))
                expected.append(m.grades[0] + t @ steps if len(steps) else np.full(len(offsets) - 1, float(m.grades[0])))
                tail.append(t[:, below[-1]] if below else np.ones(len(offsets) - 1))
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.float64())
            rest = [batch.column(k) for k in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), cat(expected), cat(tail), *rest], names=["_id", "expected_grade", "tail_probability", *keep])

    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c) for c in keep))
    kinds = dict(own.dtypes)
    schema = f"_id {kinds['_id']}, expected_grade double, tail_probability double" + "".join(f", `{c}` {kinds[c]}" for c in keep)
    return own.mapInArrow(tidied(run), schema).withColumnRenamed("_id", id_col)


def select_quality(docs: DataFrame, fitted: OrdinalModel, threshold: float = 0.5, grade: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose tail probability is at least the threshold, with the columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    top = fitted.grades[-1] if grade is None else grade
    at = docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        below = [j for j, g in enumerate(m.grades[:-1]) if g < top]
        for batch in batches:
            if not below:
                yield batch
                continue
            tail = [m.tails(means(m.weights, data, offsets))[:, below[-1]] for _, _, data, offsets in chunks(None, batch.column(at))]
            if tail:
                yield batch.filter(pa.array(np.concatenate(tail) >= threshold))

    return docs.mapInArrow(tidied(run), docs.schema)
