"""Benchmark decontamination by q-gram lemma filtering.

An item of m bytes and a region within k edits of it share at least m + 1 - q (k + 1)
q-grams, and all of these lie on k + 1 neighbouring diagonals (place in the text minus
place in the item).  Every q-gram of every text is looked up among those of the items;
hits are counted in bands of 2 (k + 1) diagonals that overlap by half, so every run
of k + 1 diagonals lies in one band.  Bands with enough hits are verified by a banded
alignment (an exact copy is found by search first).  The budget k is ``rate`` of an
item's bytes, or less where the lemma would demand nothing.

A q-gram that an item holds many times in a row counts once for each of its places in the
text and each half band, and its half bands are one interval, so a run of dashes makes two marks a place
and not one for each pair of places.  Texts are counted in stretches of bounded numbers of
hits, which overlap by the longest item, and regions that stretches share are united.

Items are indexed in blocks of bounded size (``BLOCK_BYTES`` of text, a few times more
in memory), which are broadcast; all texts are read once for each such block.

Letters A-Z count as a-z and any white-space byte as a space.  Edge cases: null or
empty texts and items match nothing; an item shorter than q bytes matches as an
exact copy between word ends; equal items match each; repeated rows are judged each;
very long texts are judged whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import NOT_SPACE, chunks, lower_ascii, mix, tidied

Q = 10
RATE = 0.08
BLOCK_BYTES = 8 << 20
RUN_HITS = 1 << 20  # hits that are counted at a time
SEND_ROWS = 1 << 15  # matches of a record batch
_U = np.uint64
_BITS = 20  # of the first look
SCHEMA = "_id long, item_id long, start int, end int, edits int"


def normal(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case with one kind of white space; places stay as they are."""
    out = lower_ascii(data)
    out[~NOT_SPACE[data]] = 0x20
    return out


def qgrams(data: np.ndarray) -> np.ndarray:
    """A 64-bit value for each run of Q bytes (two overlapping words, mixed)."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    words = np.lib.stride_tricks.as_strided(np.frombuffer(data.tobytes() + b"\0" * 8, np.uint8), (len(data), 8), (1, 1))
    w = np.ascontiguousarray(words[: len(data) - 7]).view("<u8").reshape(-1)
    return mix(w[: len(data) - Q + 1] * _U(0x9E3779B97F4A7C15) ^ (w[Q - 8 :][: len(data) - Q + 1] >> _U(8 * (16 - Q))))


def budget(m: int, rate: float) -> int:
    """Edits allowed for an item of m bytes: the lemma must still demand a fifth of a q-gram run."""
    return max(0, min(int(rate * m), (m + 1) // Q - 2))


class Index:
    """q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.ids = [i for i, _ in items]
        self.texts = [normal(np.frombuffer(t.encode(), np.uint8)).tobytes().strip() for _, t in items]
        self.k = np.array([budget(len(t), rate) for t in self.texts], np.int64)
        self.need = np.array([max(1, len(t) + 1 - Q * (k + 1)) for t, k in zip(self.texts, self.k, strict=True)], np.int64)
        self.short = [i for i, t in enumerate(self.texts) if 0 < len(t) < Q]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.reach = int((self.size + self.k).max(initial=0)) + 2 * Q  # no region is longer
        grams = [qgrams(np.frombuffer(t, np.uint8)) for t in self.texts]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.zeros(0, np.int32)
        order = np.lexsort((place, item, h))
        h, item, place = h[order], item[order], place[order]
        # places of a q-gram in an item no further apart than a half band are one interval
        apart = np.ones(len(h), bool)
        apart[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > self.k[item[1:]] + 1)
        at = np.flatnonzero(apart)
        self.item, self.low = item[at], place[at]
        self.high = place[np.append(at[1:], len(h)) - 1] if len(h) else place
        self.keys, first, count = np.unique(h[at], return_index=True, return_counts=True)
        self.first, self.count = first.astype(np.int32), count.astype(np.int32)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.keys >> _U(64 - _BITS)] = True

    def found(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of q-grams that some item holds, and their numbers among the keys."""
        h = qgrams(data)
        at = np.flatnonzero(self.maybe[h >> _U(64 - _BITS)])
        if not len(self.keys) or not len(at):
            z = np.zeros(0, np.int64)
            return z, z
        own = h[at]
        key = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ok = self.keys[key] == own
        return at[ok], key[ok]

    def marks(self, doc: np.ndarray, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Changes of the number of hits by pair (of a document and an item) and half band: +1 where an interval of half bands begins, -1 behind it."""
        parts, ends, lo = [], np.cumsum(self.count[key], dtype=np.int64), 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + RUN_HITS, "right")))
            n = self.count[key[lo:hi]].astype(np.int64)
            upto = np.cumsum(n)
            flat = np.repeat(self.first[key[lo:hi]] - (upto - n), n) + np.arange(upto[-1])
            item, place = self.item[flat].astype(np.int64), np.repeat(at[lo:hi], n)
            pair = np.repeat(doc[lo:hi], n) * len(self.ids) + item
            half, shift = self.k[item] + 1, self.size[item]
            begin, behind = (place - self.high[flat] + shift) // half, (place - self.low[flat] + shift) // half + 1
            parts.append(_summed(np.concatenate([pair, pair]), np.concatenate([begin, behind]), np.repeat([1, -1], len(item))))
            lo = hi
        if not parts:
            z = np.zeros(0, np.int64)
            return z, z, z
        return parts[0] if len(parts) == 1 else _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def regions_of(self, doc: np.ndarray, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, first and last diagonal) of bands with enough hits, for hits of whole texts or of a stretch of one."""
        pair, band, change = self.marks(doc, at, key)
        if not len(pair):
            return pair, band, change
        count = np.cumsum(change)  # every pair's changes sum to nothing, so counts start anew
        same = np.append(pair[1:] == pair[:-1], False)
        behind = np.where(same, np.append(band[1:], 0), band + 1)  # half bands [band, behind) have the count
        after = np.where(same, np.append(count[1:], 0), 0)
        item = pair % len(self.ids)
        need, half = self.need[item], self.k[item] + 1
        inside = (2 * count >= need) & (behind - band > 1) | (count >= need)
        across = count + after >= need
        ok = (inside | across) & (count + after > 0)
        low, high = np.where(inside, band, behind - 1)[ok], np.where(across, behind + 1, behind)[ok]
        return pair[ok], low * half[ok] - self.size[item[ok]], high * half[ok] - self.size[item[ok]] - 1

    def stretches(self, doc: np.ndarray, at: np.ndarray, key: np.ndarray):
        """Slices of the hits: of many whole texts, or of one text, then overlapping by the longest region."""
        hits = np.concatenate([[0], np.cumsum(self.count[key], dtype=np.int64)])
        a = 0
        while a < len(at):
            b = int(np.searchsorted(hits, hits[a] + RUN_HITS, "right")) - 1
            whole = int(np.searchsorted(doc, doc[min(b, len(at) - 1)])) if b < len(at) else len(at)  # before the text that does not fit
            if whole > a:
                yield slice(a, whole)
                a = whole
                continue
            end = int(np.searchsorted(doc, doc[a], "right"))
            while True:
                b = min(end, max(b, int(np.searchsorted(at[a:end], at[a] + 2 * self.reach, "right")) + a))
                yield slice(a, b)
                if b == end:
                    break
                a = max(a + 1, int(np.searchsorted(at[a:end], at[b] - self.reach)) + a)
                b = int(np.searchsorted(hits, hits[a] + RUN_HITS, "right")) - 1
            a = end

    def regions(self, data: np.ndarray, offsets: np.ndarray):
        """(document, item, first diagonal, last diagonal), in places of the document; regions of an item do not touch."""
        at, key = self.found(data)
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[doc + 1]
        at, key, doc = at[inside], key[inside], doc[inside]
        at = at - offsets[doc]
        parts = [self.regions_of(doc[s], at[s], key[s]) for s in self.stretches(doc, at, key)]
        if not parts:
            return
        pair, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((low, pair))
        last = None
        for p, x, y in zip(pair[order].tolist(), low[order].tolist(), high[order].tolist(), strict=True):  # regions that touch become one
            if last and last[0] == p and x <= last[2] + 1:
                last[2] = max(last[2], y)
                continue
            if last:
                yield *divmod(last[0], len(self.ids)), *last[1:]
            last = [p, x, y]
        if last:
            yield *divmod(last[0], len(self.ids)), *last[1:]


def _summed(pair: np.ndarray, band: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Changes summed by pair and band, in that order; those that cancel out go."""
    order = np.lexsort((band, pair))
    pair, band, change = pair[order], band[order], change[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])
    cut = np.flatnonzero(new)
    total = np.add.reduceat(change, cut) if len(cut) else change
    some = total != 0
    return pair[cut][some], band[cut][some], total[some]


def align(item: bytes, text: bytes, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the region of ``text`` with the fewest edits to ``item``, if at most k."""
    at = text.find(item)
    if at >= 0:
        return at, at + len(item), 0
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    far = k + 1
    ramp = np.arange(n + 1)
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for i, c in enumerate(item):
        # by column: from the diagonal, or from above
        best = np.full(n + 1, i + 1, np.int64)
        origin = start.copy()
        diag = row[:-1] + (t != c)
        up = row[1:] + 1
        best[1:] = np.minimum(diag, up)
        origin[1:] = np.where(diag <= up, start[:-1], start[1:])
        # from the left: the running minimum of best - column
        level = best - ramp
        low = np.minimum.accumulate(level)
        lead = np.maximum.accumulate(np.where(level == low, ramp, 0))
        row, start = np.minimum(low + ramp, far), origin[lead]
        if row.min() > k:
            return None
    end = int(row.argmin())
    return (int(start[end]), end, int(row[end])) if row[end] <= k else None


def _short(index: Index, data: np.ndarray, offsets: np.ndarray):
    """Exact copies of items below Q bytes, between word ends."""
    if not index.short:
        return
    raw = data.tobytes()
    for i in index.short:
        t = index.texts[i]
        at = raw.find(t)
        while at >= 0:
            d = int(np.searchsorted(offsets, at, "right")) - 1
            a, b = at - int(offsets[d]), at + len(t) - int(offsets[d])
            if at + len(t) <= offsets[d + 1] and (a == 0 or raw[at - 1] == 32) and (at + len(t) == offsets[d + 1] or raw[at + len(t)] == 32):
                yield d, i, a, b, 0
            at = raw.find(t, at + 1)


def scan(index: Index, data: np.ndarray, offsets: np.ndarray):
    """(document, item, start, end, edits) in bytes of the document.

    A wide region, which may hold an item more than once, is aligned half an item of diagonals at a time."""
    data = normal(data)
    yield from _short(index, data, offsets)
    for d, i, lo, hi in index.regions(data, offsets):
        item, k, done = index.texts[i], int(index.k[i]), 0
        length, start = int(offsets[d + 1] - offsets[d]), int(offsets[d])
        step = max(hi - lo + 1 if hi - lo <= len(item) // 2 + 2 * k else 1, len(item) // 2, 1)
        for x in range(lo, hi + 1, step):
            a, b = max(0, x - k, done), min(length, min(x + step - 1, hi) + len(item) + k + 1)
            if b - a < len(item) - k:
                continue
            found = align(item, data[start + a : start + b].tobytes(), k)
            if found is not None:
                done = a + max(found[1], 1)
                yield d, i, a + found[0], a + found[1], found[2]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Items in blocks of bounded size, streamed from the cluster."""
    items, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).where(F.length(F.trim(F.col(text_col))) > 0).toLocalIterator():
        items.append((r[0], r[1]))
        size += len(r[1])
        if size >= BLOCK_BYTES:
            yield items
            items, size = [], 0
    if items:
        yield items


def _checked(rate: float) -> None:
    if not 0 <= rate < 1 / Q:
        raise ValueError(f"rate must be in [0, {1 / Q})")


def _matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per match: _id, item_id, start, end, edits."""
    _checked(rate)
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.col("_text").isNotNull())
    out = None
    for items in item_blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(Index(items, rate))

        def run(batches, shared=shared):
            index, rows = shared.value, []
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            send = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["_id", "item_id", "start", "end", "edits"])
            for batch in batches:
                for at, _, data, offsets in chunks(None, batch.column("_text")):
                    last, upto = -1, None
                    for d, i, a, b, edits in sorted(scan(index, data, offsets)):
                        if d != last:
                            last, upto = d, np.concatenate([[0], np.cumsum(data[offsets[d] : offsets[d + 1]] & 0xC0 != 0x80)])  # characters before each byte
                        rows.append((batch.column("_id")[at + d].as_py(), index.ids[i], int(upto[a]), int(upto[b]), edits))
                        if len(rows) >= SEND_ROWS:
                            yield send(rows)
                            rows = []
            if rows:
                yield send(rows)

        part = own.mapInArrow(tidied(run), SCHEMA)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], SCHEMA)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per match: id, item_id, start and end (characters of the text), edits."""
    return _matches(docs, benchmark, rate, id_col, text_col, item_col, item_text_col).withColumnRenamed("_id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text has no match, whatever other rows share their id.

    Each block of items filters the rows where they are read; nothing is shuffled, and the documents are read once."""
    _checked(rate)
    at, schema = docs.columns.index(text_col), docs.schema
    for items in item_blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items, rate))

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                column = batch.column(at)
                for lo, _, data, offsets in chunks(None, column if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(pa.string())):
                    for match in scan(index, data, offsets):
                        bad[lo + match[0]] = True
                yield batch.filter(pa.array(~bad)) if bad.any() else batch

        docs = docs.mapInArrow(tidied(run), schema)
    return docs
