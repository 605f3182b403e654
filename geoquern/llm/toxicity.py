"""Toxicity: a linear-chain conditional random field over tokens.

Tokens get a label from the document labels: the fewest token types (words, or the first
four letters of words) that explain the toxic training documents, and are rare in clean
ones, mark their tokens in toxic documents.  The field has two tags, weights for hashed
features of a token (word, first four and first five letters, last three, and the words
beside it) and for transitions, and is fitted by the gradient of the
log-likelihood of the labelled tokens.  Forward-backward gives every token's marginal;
the document score is a logistic function of the highest marginal and of the
sum of those above one half, fitted on the training documents.  Tokens with a marginal
of at least ``SPAN`` are the offending offsets.

The chain of a document is one, however long: it is cut into runs of ``RUN`` tokens, all runs of a batch advance
together, and each run's product of transitions carries the forward and backward messages
over to its neighbours before the run is gone through with them.  Fitting reads a bounded sample of the
labelled rows that ``where`` admits; scoring reads nothing but the text.

Edge cases: null and empty texts have no tokens and get the score of a text without
offending tokens; without toxic training rows every score is 0; repeated rows score
alike; very long texts are scored whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._sample import FIT_BYTES, MAX_CHARS, PER_CLASS, labelled_sample
from ._text import ALNUM, chunks, lower_ascii, mix, span_hashes, tidied, word_spans

BITS = 18
RUN = 128
SPAN = 0.5
SUPPORT, LOG_ODDS, CLEAN_COST, COMMON = 3, 2.0, 3.0, 0.05  # of a token type that marks its tokens
_U = np.uint64


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Spans of the words of lower-cased texts."""
    return word_spans(data, offsets, ALNUM)


def _pick(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h ^ _U(0x9E3779B97F4A7C15 * (kind + 1) & (1 << 64) - 1)) >> _U(64 - BITS)).astype(np.int32)


def features(data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bins by token: word, prefixes, suffix, the words before and after (in the same document)."""
    word = span_hashes(data, s, e)
    own = _pick(word, 0)
    before, after = _pick(word, 4), _pick(word, 5)
    left, right = np.full(len(s), -1, np.int32), np.full(len(s), -1, np.int32)
    left[1:], right[:-1] = before[:-1], after[1:]
    a = first[:-1][np.diff(first) > 0]
    b = first[1:][np.diff(first) > 0] - 1
    left[a], right[b] = -1, -1
    cut = lambda n: span_hashes(data, s, np.minimum(e, s + n))
    tail = span_hashes(data, np.maximum(s, e - 3), e)
    return np.stack([own, _pick(cut(4), 1), _pick(cut(5), 2), _pick(tail, 3), left, right], axis=1)


@dataclass(frozen=True)
class Crf:
    unary: np.ndarray  # 2**BITS + 1 weights of tag 1 (the last one stays 0), without the bias
    bias: float
    trans: np.ndarray  # 2 x 2
    score: tuple[float, float, float]  # logistic: constant, highest marginal, offending mass


def _runs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths, documents and places in the document of the runs."""
    n = np.diff(first)
    parts = -(-n // RUN)
    doc = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first[:-1][doc] + k * RUN
    return start, np.minimum(RUN, first[1:][doc] - start), doc, k


def forward_backward(u: np.ndarray, first: np.ndarray, trans: np.ndarray):
    """Marginal of tag 1 by token, log-partition by document, expected transitions (2 x 2).

    ``u`` are the scores of tag 1 (those of tag 0 are 0) of the tokens of all documents, which start at ``first``."""
    start, length, doc, place = _runs(first)
    order = np.argsort(-length, kind="stable")  # runs by falling length: those that have a step are a prefix
    start, length, doc, place = start[order], length[order], doc[order], place[order]
    k = len(start)
    p, pairs, logz = np.zeros(len(u)), np.zeros((2, 2)), np.zeros(len(first) - 1)
    if not k:
        return p, logz, pairs
    alive = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right")
    t = np.exp(trans)
    e = np.exp(np.clip(u, -50, 50))
    lead = place == 0
    coming, leaving = np.ones((k, 2)), np.ones((k, 2))
    if (~lead).any():
        # what a run makes of the message before it, for either tag: its product of transitions and scores, scaled
        through = np.broadcast_to(np.eye(2), (k, 2, 2)).copy()
        for j, n in enumerate(alive):
            x = through[:n] @ t
            if j == 0:
                x[lead[:n]] = np.eye(2)
            x[:, :, 1] *= e[start[:n] + j][:, None]
            through[:n] = x / x.sum((1, 2), keepdims=True)
        at = np.empty(k, np.int64)
        at[np.lexsort((place, doc))] = np.arange(k)
        seq = np.argsort(at)  # runs in the order of the documents
        last = np.append(doc[seq][1:] != doc[seq][:-1], True)
        for r in range(1, int(place.max()) + 1):
            own = np.flatnonzero(place[seq] == r)
            message = (coming[seq[own - 1]][:, None, :] @ through[seq[own - 1]])[:, 0]
            coming[seq[own]] = message / message.sum(1, keepdims=True)
        for r in range(int(place.max()) - 1, -1, -1):
            own = np.flatnonzero((place[seq] == r) & ~last)
            message = (through[seq[own + 1]] @ leaving[seq[own + 1]][:, :, None])[:, :, 0]
            leaving[seq[own]] = message / message.sum(1, keepdims=True)
    a = np.zeros((len(alive), k, 2))
    scale = np.ones((len(alive), k))
    for j, n in enumerate(alive):
        x = np.where(lead[:n, None], coming[:n], coming[:n] @ t) if j == 0 else a[j - 1, :n] @ t
        x = x * np.stack([np.ones(n), e[start[:n] + j]], axis=1)
        scale[j, :n] = x.sum(1)
        a[j, :n] = x / scale[j, :n, None]
    b = leaving / (a[length - 1, np.arange(k)] * leaving).sum(1, keepdims=True)
    for j in range(len(alive) - 1, -1, -1):
        n = alive[j]
        m = a[j, :n] * b[:n]
        p[start[:n] + j] = m[:, 1] / m.sum(1)
        back = b[:n] * np.stack([np.ones(n), e[start[:n] + j]], axis=1) / scale[j, :n, None]
        if j:
            pairs += (a[j - 1, :n].T @ back) * t
            b[:n] = back @ t.T
        else:
            pairs += (coming[~lead].T @ back[~lead]) * t
    np.add.at(logz, doc, np.log(scale).sum(0))
    return p, logz, pairs


def unary_scores(w: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """Sum of the weights of each token's bins, column by column (no table of all of them)."""
    out = np.zeros(len(feats))
    for c in range(feats.shape[1]):
        out += w[feats[:, c]]
    return out


def marginals(model: Crf, data: np.ndarray, s, e, first) -> np.ndarray:
    if not len(s):
        return np.zeros(0)
    u = unary_scores(model.unary, features(data, s, e, first)) + model.bias
    return forward_backward(u, first, model.trans)[0]


def summary(p: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document the highest marginal, and log(1 + the sum of those from SPAN on)."""
    n = np.diff(first)
    top = np.zeros(len(n))
    some = n > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, first[:-1][some])
    mass = np.concatenate([[0.0], np.cumsum(np.where(p >= SPAN, p, 0.0))])
    return top, np.log1p(np.maximum(0, mass[first[1:]] - mass[first[:-1]]))


def _label_tokens(feats: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tags of training tokens: the fewest types (words or prefixes) that explain the toxic documents.

    Types that are common in toxic documents and all but absent from clean ones come first; then
    types are taken greedily by how many unexplained toxic documents hold them, less those
    of clean documents; so words that merely stand in copies of one text are not taken."""
    size = 1 << BITS
    key = np.unique(np.concatenate([doc.astype(np.int64) * (2 * size) + c * size + feats[:, c] for c in (0, 1)]))
    d, f = key // (2 * size), key % (2 * size)
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    pos, neg = np.bincount(f[y[d] == 1], minlength=2 * size), np.bincount(f[y[d] == 0], minlength=2 * size)
    speaks = np.log((pos + 0.5) / n1) - np.log((neg + 0.5) / n0) >= LOG_ODDS
    own = (y[d] == 1) & speaks[f]
    d, f = d[own], f[own]
    chosen = speaks & (pos >= np.maximum(SUPPORT, COMMON * n1)) & (pos >= CLEAN_COST * 10 * neg)
    left = ~np.isin(d, d[chosen[f]])
    d, f = d[left], f[left]
    while len(f):
        gain = np.bincount(f, minlength=2 * size) - CLEAN_COST * neg
        best = int(gain.argmax())
        if gain[best] < SUPPORT:
            break
        chosen[best] = True
        left = ~np.isin(d, d[f == best])
        d, f = d[left], f[left]
    return (chosen[feats[:, 0]] | chosen[size + feats[:, 1]]) & (y[doc] == 1)


def fit_crf(sample: list[tuple[int, str]], rounds: int = 30, rate: float = 0.3, l2: float = 1e-6) -> Crf:
    y = np.array([1 if v else 0 for v, _ in sample])
    none = Crf(np.zeros((1 << BITS) + 1), -20.0, np.zeros((2, 2)), (-20.0, 0.0, 0.0))
    if not y.any():
        return none
    column = pa.array([t for _, t in sample], pa.string())
    feats, doc, firsts, base = [], [], [np.zeros(1, np.int64)], 0
    for at, _, data, offsets in chunks(None, column, FIT_BYTES):
        data = lower_ascii(data)
        s, e, first = tokens(data, offsets)
        if len(s):
            feats.append(features(data, s, e, first))
            doc.append(at + np.repeat(np.arange(len(first) - 1), np.diff(first)))
        firsts.append(first[1:] + base)
        base += len(s)
    if not feats:
        return none
    feats, doc, first = np.concatenate(feats), np.concatenate(doc), np.concatenate(firsts)
    gold = _label_tokens(feats, doc, y).astype(float)
    same = np.ones(len(gold), bool)
    same[first[:-1][np.diff(first) > 0]] = False
    now, prev = gold[same].astype(int), gold[np.flatnonzero(same) - 1].astype(int)
    seen = np.bincount(prev * 2 + now, minlength=4).reshape(2, 2)
    w, bias, trans = np.zeros((1 << BITS) + 1), np.zeros(1), np.zeros((2, 2))
    share = (gold.mean() + 1e-6) / (1 - gold.mean() + 1e-6)
    bias[0] = np.log(share)
    count = max(1.0, gold.sum())
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, bias, trans)]
    for step in range(1, rounds + 1):
        p, _, pairs = forward_backward(unary_scores(w, feats) + bias[0], first, trans)
        g = (p - gold) / count
        gw = np.zeros(len(w))
        for c in range(feats.shape[1]):
            gw += np.bincount(feats[:, c] % len(w), g, len(w))
        gw[-1] = 0
        gw += l2 * w
        for x, d, (m, v) in zip((w, bias, trans), (gw, np.array([g.sum()]), (pairs - seen) / count + l2 * trans), state, strict=True):
            m *= 0.9
            m += 0.1 * d
            v *= 0.999
            v += 0.001 * d * d
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    p, _, _ = forward_backward(unary_scores(w, feats) + bias[0], first, trans)
    return Crf(w, float(bias[0]), trans, _fit_score(*summary(p, first), y))


def _fit_score(top: np.ndarray, mass: np.ndarray, y: np.ndarray, rounds: int = 30, l2: float = 1e-2) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method."""
    x = np.stack([np.ones(len(y)), top, mass], axis=1)
    b = np.zeros(3)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (q - y) + l2 * b
        b -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + l2 * np.eye(3), grad)
    return tuple(float(v) for v in b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, where: Column | None = None) -> Crf:
    """``where`` is a condition on the label rows, whose id is the column ``_id``."""
    return fit_crf(labelled_sample(docs, labels, label_col, id_col, text_col, per_class, max_chars, where))


def score_toxicity(docs: DataFrame, fitted: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), spans: array of the offending tokens (start, end in characters, marginal)."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # 2**BITS weights
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    def run(batches):
        model = shared.value
        for batch in batches:
            scores, spans = [], []
            for _, _, raw, offsets in chunks(None, batch.column(1)):
                data = lower_ascii(raw)
                s, e, first = tokens(data, offsets)
                p = marginals(model, data, s, e, first)
                top, mass = summary(p, first)
                c = model.score
                scores.append(1 / (1 + np.exp(-np.clip(c[0] + c[1] * top + c[2] * mass, -60, 60))))
                own: list[list] = [[] for _ in range(len(offsets) - 1)]
                at = np.flatnonzero(p >= SPAN)
                if len(at):
                    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters before each byte
                    doc = np.searchsorted(first, at, "right") - 1
                    zero = lead[offsets[doc]]
                    for d, a, b, q in zip(doc, lead[s[at]] - zero, lead[e[at]] - zero, p[at], strict=True):
                        own[d].append((int(a), int(b), float(q)))
                spans += own
            cat = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cat, pa.float64()), pa.array(spans, pa.list_(span))], names=["_id", "score", "spans"])

    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return own.mapInArrow(tidied(run), "_id long, score double, spans array<struct<start:int,end:int,p:double>>").withColumnRenamed("_id", id_col)
