"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

A model file gives pieces and scores; the encoding of a text is the segmentation with
the highest sum of scores (the unigram lattice of SentencePiece, with its unknown
score and byte fallback).  A BPE model stores merge ranks, which are no
log-probabilities; for such a model the score of rank r is taken by Zipf's law as
-log(r + ZIPF), so ids are those of this lattice and not of the merge order (the
text comes back exactly either way).  White space is escaped as in SentencePiece.  No piece
holds an escape after another character, so the lattice falls into words, and each
distinct word of a task is encoded once: words of equal length advance together,
hashes of all their substrings are looked up in sorted piece hashes (and compared
with the piece itself), and each step takes the maximum over the lengths, storing
the chosen length as back pointer.  Long words are looked up in blocks of columns.

Ties go to the longest last piece, as in the library.  The escape character itself, if
a text holds it, is written as bytes, so that every text comes back unchanged.

Edge cases: a null text gives null ids; an empty one an empty list; very long
texts and words are encoded whole; repeated rows are encoded each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import mix, powers, tidied

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
BPE = 2  # model type
ZIPF = 100.0
FILTER_BITS = 18  # a first look by the upper bits of a hash
CELLS = 1 << 20  # substrings looked up at once
CACHE_WORDS = 1_000_000
ALONE = 2048  # characters of a word that is gone through by itself
CHUNK_CHARS = 2 << 20
_U = np.uint64


def _fields(data: bytes):
    """(number, wire value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 5:
            yield key >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif kind == 1:
            yield key >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError("not a SentencePiece model")


class Model:
    """Pieces of a model file, as tables for substring lookups and for decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        pieces, self.dummy_prefix, self.byte_fallback, kind = [], True, False, 1
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
                pieces.append((piece[1].decode(), piece[2], piece[3]))
            elif number == 2:
                spec = dict(_fields(value))
                self.byte_fallback, kind = bool(spec.get(35, 0)), spec.get(3, 1)
            elif number == 3:
                spec = dict(_fields(value))
                self.dummy_prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("models that normalise texts are not supported")
        if kind == BPE:
            ranks = np.minimum(-np.array([p[1] for p in pieces]), len(pieces))
            pieces = [(t, float(-np.log(max(r, 0.0) + ZIPF)), k) for (t, _, k), r in zip(pieces, ranks, strict=True)]
        self.kinds = [p[2] for p in pieces]
        self.unknown = self.kinds.index(UNKNOWN)
        scores = [p[1] for p in pieces if p[2] == NORMAL]
        self.unknown_score = min(scores) - UNKNOWN_PENALTY
        usable = [(t, s if k == NORMAL else len(t) * max(scores) - 0.1, i) for i, (t, s, k) in enumerate(pieces) if k in (NORMAL, USER) and t]
        self.whole_texts = any(SPACE in t.lstrip(SPACE) for t, _, _ in usable)
        self.has_line_end = any("\n" in t for t, _, _ in usable)
        self.bytes = np.full(256, self.unknown, np.int32)
        for i, (t, _, k) in enumerate(pieces):
            if k == BYTE:
                self.bytes[int(t[3:5], 16)] = i
        by: dict[int, list] = {}
        for t, s, i in usable:
            by.setdefault(len(t), []).append((t, s, i))
        self.longest = max(by)
        self.tables = {}
        for n, group in by.items():
            chars = np.frombuffer("".join(t for t, _, _ in group).encode("utf-32-le"), np.uint32).reshape(-1, n)
            h = self._hash(chars, n)[:, 0]
            order = np.argsort(h)
            maybe = np.zeros(1 << FILTER_BITS, bool)
            maybe[h >> _U(64 - FILTER_BITS)] = True
            self.tables[n] = (maybe, h[order], chars[order], np.array([s for _, s, _ in group])[order], np.array([i for _, _, i in group], np.int32)[order])
        out = []
        for t, _, k in pieces:
            out.append(bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.replace(SPACE, " ").encode())
        self.out = out

    @staticmethod
    def _hash(chars: np.ndarray, n: int) -> np.ndarray:
        """Hash of every substring of n characters, by row and start."""
        k, width = chars.shape
        sums = np.zeros((k, width + 1), np.uint64)
        np.cumsum((chars.astype(np.uint64) + _U(1)) * powers(width, 3), axis=1, out=sums[:, 1:])
        return mix((sums[:, n:] - sums[:, :-n]) * powers(width, 3, True)[: width - n + 1])

    def _lookup(self, chars: np.ndarray, lo: int, hi: int):
        """Scores and ids of the pieces that start in [lo, hi), by length: arrays of (words, starts)."""
        out = {}
        part = chars[:, lo : min(chars.shape[1], hi + self.longest - 1)]
        k, width = part.shape
        sums = np.zeros((k, width + 1), np.uint64)
        np.cumsum((part.astype(np.uint64) + _U(1)) * powers(width, 3), axis=1, out=sums[:, 1:])
        back = powers(width + 1, 3, True)
        for n, (maybe, keys, table, scores, ids) in self.tables.items():
            starts = min(hi - lo, width - n + 1)
            if starts <= 0:
                continue
            h = mix((sums[:, n : n + starts] - sums[:, :starts]) * back[:starts])
            r, c = np.nonzero(maybe[h >> _U(64 - FILTER_BITS)])
            own = h[r, c]
            hit = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            same = keys[hit] == own
            for j in range(n):
                same &= part[r, c + j] == table[hit, j]
            r, c, hit = r[same], c[same], hit[same]
            score = np.full((k, starts), -np.inf)
            piece = np.full((k, starts), -1, np.int32)
            score[r, c], piece[r, c] = scores[hit], ids[hit]
            out[n] = (score, piece)
        if 1 not in out:
            out[1] = (np.full((k, hi - lo), -np.inf), np.full((k, hi - lo), -1, np.int32))
        score, piece = out[1]
        score[piece < 0] = self.unknown_score
        piece[piece < 0] = self.unknown
        return out

    def _viterbi(self, chars: np.ndarray):
        """Best segmentation of words of one length: (lengths, ids) of the pieces, back from the end."""
        k, width = chars.shape
        best = np.full((width + 1, k), -np.inf)
        best[0] = 0.0
        step = np.zeros((width + 1, k), np.int8 if self.longest < 128 else np.int32)
        piece = np.zeros((width + 1, k), np.int32)
        block = max(64, CELLS // (k * self.longest))
        rows = np.arange(k)
        for lo in range(0, width, block):
            hi = min(width, lo + block)
            first = max(0, lo - self.longest + 1)
            found = self._lookup(chars, first, hi)
            lengths = sorted(found, reverse=True)
            for end in range(lo + 1, hi + 1):
                own = [n for n in lengths if n <= end and end - n - first < found[n][0].shape[1]]
                cand = np.stack([best[end - n] + found[n][0][:, end - n - first] for n in own])
                top = cand.argmax(0)
                best[end] = cand[top, rows]
                step[end] = np.array(own)[top]
                piece[end] = np.stack([found[n][1][:, end - n - first] for n in own])[top, rows]
        lens, ids, at = [], [], np.full(k, width)
        while at.any():
            n = np.where(at > 0, step[at, rows], 0)
            lens.append(n)
            ids.append(np.where(n > 0, piece[at, rows], -1))
            at = at - n
        return np.array(lens), np.array(ids)

    def _viterbi_alone(self, chars: np.ndarray):
        """As ``_viterbi`` for one long word: only the pieces found are tried, one end after the other."""
        width = chars.shape[1]
        best, step, piece = [0.0] + [-math.inf] * width, [0] * (width + 1), [0] * (width + 1)
        block = max(64, CELLS // (8 * self.longest))
        for lo in range(0, width, block):
            hi = min(width, lo + block)
            first = max(0, lo - self.longest + 1)
            ends, lengths, scores, ids = [], [], [], []
            for n, (score, own) in self._lookup(chars, first, hi).items():
                at = np.flatnonzero(own[0] >= 0)
                at = at[(at + first + n > lo) & (at + first + n <= hi)]
                ends.append(at + first + n)
                lengths.append(np.full(len(at), n))
                scores.append(score[0, at])
                ids.append(own[0, at])
            ends, lengths, scores, ids = map(np.concatenate, (ends, lengths, scores, ids))
            order = np.lexsort((-lengths, ends))  # ties go to the longest
            for end, n, score, own in zip(ends[order].tolist(), lengths[order].tolist(), scores[order].tolist(), ids[order].tolist(), strict=True):
                total = best[end - n] + score
                if total > best[end]:
                    best[end], step[end], piece[end] = total, n, own
        lens, ids, at = [], [], width
        while at:
            lens.append(step[at])
            ids.append(piece[at])
            at -= step[at]
        return np.array(lens)[:, None], np.array(ids, np.int32)[:, None]

    def encode_words(self, words: list[str]):
        """Ids of (escaped) words, in groups: (indexes of the words, their counts, all their ids)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        chars = np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths[order])
        at = 0
        while at < len(order):
            n = int(lengths[order[at]])
            to = min(int(np.searchsorted(lengths[order], n, "right")), at + max(1, CELLS // (n * self.longest)))
            own = order[at:to]
            if n >= ALONE:  # too long for many to advance together
                to = at + 1
            lens, ids = (self._viterbi_alone if n >= ALONE else self._viterbi)(chars[ends[at] - n : ends[to - 1]].reshape(-1, n))
            odd = (ids == self.unknown).any(0) if self.byte_fallback else np.zeros(len(own), bool)
            back = ids.T[:, ::-1]
            kept = back[~odd]
            yield own[~odd], (kept >= 0).sum(1), kept[kept >= 0]
            for col in np.flatnonzero(odd):
                x, w = back[col], lens[:, col][::-1]
                x = self._bytes(words[own[col]], x[x >= 0], w[w > 0])
                yield own[col : col + 1], np.array([len(x)]), x
            at = to

    def _bytes(self, word: str, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        out, at = [], 0
        for i, n in zip(ids.tolist(), lens.tolist(), strict=True):
            out += self.bytes[list(word[at : at + n].encode())].tolist() if i == self.unknown else [int(i)]
            at += n
        return np.array(out, np.int32)

    def decode(self, ids) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


class Encoder:
    """Encodes texts with a bounded memory of the words met so far."""

    def __init__(self, m: Model):
        self.m = m
        # no piece holds a line end: it is always a step of its own, so the lattice falls apart there too
        line = "" if m.has_line_end else "\n"
        self._words = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + f"|{line}" * bool(line))
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.tokens, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _room(self, tokens: int, words: int):
        while self.used + tokens > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros(len(self.tokens), np.int32)])
        while words > len(self.start):
            self.start, self.count = (np.concatenate([a, np.zeros(len(a), np.int64)]) for a in (self.start, self.count))

    def _learn(self, words: list[str]):
        base = len(self.known)
        for own, n, flat in self.m.encode_words(words):
            self._room(len(flat), base + len(words))
            self.tokens[self.used : self.used + len(flat)] = flat
            self.start[base + own] = self.used + np.cumsum(n) - n
            self.count[base + own] = n
            self.used += len(flat)
        self.known.update(zip(words, range(base, base + len(words)), strict=True))

    def _learn_escape(self):
        i = len(self.known)
        x = self.m.bytes[list(SPACE.encode())]
        self._room(len(x), i + 1)
        self.tokens[self.used : self.used + len(x)] = x
        self.start[i], self.count[i] = self.used, len(x)
        self.used += len(x)
        self.known[None] = i

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        if SPACE in text:  # kept apart: the private stand-in is no piece, so it is written as bytes
            parts = text.split(SPACE)
            return [x for k, p in enumerate(parts) for x in ([None] if k else []) + self._split(p, k == 0)]
        return self._split(text, True)

    def _split(self, text: str, first: bool) -> list[str]:
        text = (SPACE if first and self.m.dummy_prefix else "") + text.replace(" ", SPACE)
        if not text:
            return []
        return [text] if self.m.whole_texts else self._words.findall(text)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets by text)."""
        split = [self.split(t) for t in texts]
        distinct = set().union(*split)
        escaped = None in distinct
        distinct.discard(None)
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self._clear()
            new = list(distinct)
        if new:
            self._learn(new)
        if escaped and None not in self.known:
            self._learn_escape()
        get = self.known.__getitem__
        at = np.array(list(map(get, chain.from_iterable(split))), np.int64)
        n = self.count[at]
        ends = np.cumsum(n)
        flat = self.tokens[np.repeat(self.start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        return flat, np.concatenate([[0], ends])[upto]


def encode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """id, ids (array of piece ids), n_tokens; with ``check`` also round_trip: whether decoding gives the text back."""

    def run(batches):
        m = model(model_path)
        enc = Encoder(m)
        for batch in batches:
            column = batch.column(1)
            flats, lens, exact = [], [], []
            at = 0
            while at < len(column):
                texts, size = [], 0
                while at < len(column) and (not texts or size < CHUNK_CHARS):
                    t = column[at].as_py()
                    texts.append(t)
                    size += len(t or "")
                    at += 1
                flat, offsets = enc([t or "" for t in texts])
                flats.append(flat)
                lens.append(np.diff(offsets))
                if check:
                    listed = flat.tolist()
                    exact += [None if t is None else m.decode(listed[a:b]) == t for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)]
            n = np.concatenate(lens) if lens else np.zeros(0, np.int64)
            flat = np.concatenate(flats) if flats else np.zeros(0, np.int32)
            null = column.is_null().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)), pa.array(flat, pa.int32()))
            cols = [batch.column(0), ids, pa.array(n, pa.int64(), mask=null)]
            names = ["_id", "ids", "n_tokens"]
            if check:
                cols, names = [*cols, pa.array(exact, pa.bool_())], [*names, "round_trip"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return own.mapInArrow(tidied(run), "_id long, ids array<int>, n_tokens long" + ", round_trip boolean" * check).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text of every row of piece ids; null ids give a null text."""

    def run(batches):
        m = model(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else m.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["_id", "text"])

    own = encoded.select(F.col(id_col).cast("long").alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))
    return own.mapInArrow(tidied(run), "_id long, text string").withColumnRenamed("_id", id_col)
