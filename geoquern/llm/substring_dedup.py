"""Substring deduplication with fixed-block anchors.

A repeat is a run of ``min_words`` words that also starts earlier.  Any window of
``min_words`` words holds a whole aligned block of ``(min_words + 1) // 2`` words,
so it is enough to index the non-overlapping blocks and to probe them with every
rolling window of that width:

1. *Index and probe.*  Each task turns its texts into packs of short fingerprints
   of all rolling windows (sorted, delta coded, once per pack) and of the aligned
   blocks with their place.  Packs meet in buckets of the fingerprint's range; a
   block is live if its words stand anywhere else.
2. *Extend.*  In documents with live blocks, every window around a live block is
   hashed to 96 bits; equal windows meet in a bucket (each task sends its first
   one only), and all but the first are repeats.  Overlapping repeats join up to
   maximal ones.
3. *Cut.*  Words covered by a repeat are removed.

No step lists pairs, and a passage that a third of all documents share makes one
entry per pack.  Fingerprint collisions in step 1 only add candidates; their bits and the
number of buckets follow the bytes of the input, so neither the share of false candidates nor a
bucket grows with it.  Step 2 takes windows as equal by 96 bits of hash and does not compare their
words: at 10**13 windows the chance that any two others meet is below one in a thousand.

Edge cases: a null or empty text has no words and loses none; a null id counts as
smaller than all others and is returned as null; identical rows (same id and text)
are one document and do not remove each other; rows with one id (or none) and other
texts are documents of their own, in the order of a hash of the text; an empty table
gives an empty result; other columns are ignored.  Very long texts are taken whole.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import NOT_SPACE, chunks, ensure_checkpoint_dir, span_hashes, spark_partitions, tidied, window_hashes, windows, word_spans

_NULL_ID = -(1 << 63)
_U = np.uint64
#: Text that one task gathers before it sends a pack.
PACK_BYTES = 24 << 20
#: Least bits of a step-1 fingerprint; fewer mean more candidates, never other results.
ANCHOR_BITS = 44
#: Text whose windows meet in one bucket, and the most buckets (each pack sends a row to every one).
BUCKET_BYTES = 32 << 20
MOST_BUCKETS = 1 << 18
#: Places for ids that several texts share; ids that meet in one only send wider keys, never other results.
SLOTS = 1 << 16


# -- packing ---------------------------------------------------------------
def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values as differences of a few bytes; larger ones stand apart."""
    d = np.diff(values, prepend=_U(0)).astype("<u8")
    mean = int(values[-1] - values[0]) / len(values) + 1 if len(values) else 1
    wide = min((3, 4, 5, 6), key=lambda w: w + 12 * math.exp(-(256.0**w) / mean))  # bytes of a difference, if gaps fall off evenly
    far = np.flatnonzero(d >> _U(8 * wide))
    low = d.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()
    return struct.pack("<iii", len(d), len(far), wide) + low + far.astype("<i4").tobytes() + d[far].tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    n, k, width = struct.unpack_from("<iii", blob)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8, width * n, 12).reshape(n, width)
    d = wide.reshape(-1).view("<u8").copy()
    at = np.frombuffer(blob, "<i4", k, 12 + width * n)
    d[at] = np.frombuffer(blob, "<u8", k, 12 + width * n + 4 * k)
    return np.cumsum(d, dtype=np.uint64)


def pack_columns(*columns: np.ndarray) -> bytes:
    """Columns of one length by byte planes, compressed: equal high bytes cost nothing."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, c.itemsize).T.tobytes() for c in columns)
    return struct.pack("<i", n) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_columns(blob: bytes, *kinds: str) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<i", blob)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), np.uint8)
    out, at = [], 0
    for kind in kinds:
        k = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(planes[at : at + k * n].reshape(k, n).T).reshape(-1).view(kind))
        at += k * n
    return out


def _by_bucket(bucket: np.ndarray):
    """(bucket, slice of the order) for values sorted by bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    return [(int(b[i]), order[i:j]) for i, j in zip([0, *cuts], [*cuts, len(b)], strict=True) if j > i]


# -- step 1 ----------------------------------------------------------------
def _index_and_probe(width: int, buckets: int, bits: int):
    def flush(found, anchors):
        h, n = np.unique(np.concatenate(found), return_counts=True)
        twice = h[n > 1]
        ah, aid, aver, ablock = (np.concatenate(x) for x in zip(*anchors, strict=True))
        edge = lambda x: ((x >> _U(bits - 32)) * _U(buckets)) >> _U(32)
        hb, tb = edge(h), edge(twice)
        blocks = dict(_by_bucket(edge(ah)))
        rows = []
        for b, at in _by_bucket(hb):
            lo, hi = np.searchsorted(tb, [_U(b), _U(b + 1)])
            a = blocks.get(b, np.zeros(0, int))
            rows.append((b, pack_sorted(h[at]), pack_sorted(twice[lo:hi]), pack_columns(ah[a], aid[a], aver[a], ablock[a])))
        names = ["bucket", "probes", "twice", "blocks"]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(zip(*rows, strict=True))], names=names)

    def run(batches):
        found, anchors, size = [], [], 0
        for batch in batches:
            ids, vers = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_id", "_ver"))
            for at, _, data, offsets in chunks(None, batch.column("_text")):
                s, e, first = word_spans(data, offsets, NOT_SPACE)
                w = windows(first, width)
                if len(w):
                    h = window_hashes(span_hashes(data, s, e), w, width) >> _U(64 - bits)
                    doc = np.searchsorted(first, w, "right") - 1
                    pos = w - first[doc]
                    own = pos % width == 0
                    found.append(h)
                    anchors.append((h[own], ids[at + doc[own]], vers[at + doc[own]], (pos[own] // width).astype(np.int32)))
                size += len(data)
                if size >= PACK_BYTES and found:
                    yield flush(found, anchors)
                    found, anchors, size = [], [], 0
        if found:
            yield flush(found, anchors)

    return run


def _live_blocks(table: pa.Table) -> pa.Table:
    seen, n = np.unique(np.concatenate([unpack_sorted(x) for x in table["probes"].to_pylist()]), return_counts=True)
    live = np.union1d(seen[n > 1], np.concatenate([unpack_sorted(x) for x in table["twice"].to_pylist()]))
    parts = []
    for x in table["blocks"].to_pylist():
        h, *place = unpack_columns(x, "<u8", "<i8", "<i8", "<i4")
        hit = np.isin(h, live)
        parts.append([c[hit] for c in place])
    return pa.table({n: np.concatenate(c) for n, c in zip(["_id", "_ver", "_block"], zip(*parts, strict=True), strict=True)})


# -- step 2 ----------------------------------------------------------------
def _keep_first(h1, h2, ids, vers, starts):
    """The order by window and place, the first of each window, and whether an entry stands later than that."""
    order = np.lexsort((starts, vers, ids, h2, h1))
    h1, h2, ids, vers, starts = (x[order] for x in (h1, h2, ids, vers, starts))
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = (ids != ids[lead]) | (vers != vers[lead]) | (starts != starts[lead])
    return (h1, h2, ids, vers, starts), new, later


def _runs(ids, vers, starts):
    """Neighbouring starts of a document as (id, version, start, length)."""
    if not len(ids):
        return ids, vers, starts, starts
    order = np.lexsort((starts, vers, ids))
    ids, vers, starts = ids[order], vers[order], starts[order].astype(np.int64)
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (vers[1:] != vers[:-1]) | (starts[1:] > starts[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(ids)) - 1
    return ids[at], vers[at], starts[at], starts[last] - starts[at] + 1


def _candidates(width: int, min_words: int, buckets: int):
    names = ["bucket", "firsts", "repeats"]

    def flush(parts):
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        key, (h1, h2, ids, vers, starts) = cols[0], cols[1:]
        order = np.lexsort((starts, vers, ids, h2, h1))
        (h1, h2, ids, vers, starts), new, later = _keep_first(h1, h2, ids, vers, starts)
        key = key[order]
        rid, rver, rstart, rlen = _runs(ids[later], vers[later], starts[later])
        rest = dict(_by_bucket(span_spread(rid + rver) % _U(buckets)))
        rows = []
        kept = np.flatnonzero(new)
        firsts = {b: kept[at] for b, at in _by_bucket(key[kept] % _U(buckets))}
        for b in sorted(set(firsts) | set(rest)):
            f, r = firsts.get(b, kept[:0]), rest.get(b, kept[:0])
            rows.append((b, pack_columns(h1[f], h2[f], ids[f], vers[f], starts[f]), pack_columns(rid[r], rver[r], rstart[r].astype(np.int32), rlen[r].astype(np.int32))))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(zip(*rows, strict=True))], names=names)

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        parts, size = [], 0
        for batch in batches:
            ids, vers = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_id", "_ver"))
            texts = pa.array([unzip.decompress(x.as_py()) if len(x.as_py()) else b"" for x in batch.column("_z")], pa.binary()).cast(pa.string())
            blocks = batch.column("_blocks")
            for at, to, data, offsets in chunks(None, texts):
                s, e, first = word_spans(data, offsets, NOT_SPACE)
                counts = np.diff(first)
                # live[k + base of the document]: block k is live
                base = np.concatenate([[0], np.cumsum(counts // width + 2)])
                live = np.zeros(base[-1], bool)
                for d in range(at, to):
                    b = blocks[d].values.to_numpy(zero_copy_only=False)
                    b = b[b < counts[d - at] // width + 2]
                    live[base[d - at] + b] = True
                w = windows(first, min_words)
                if not len(w):
                    continue
                doc = np.searchsorted(first, w, "right") - 1
                pos = w - first[doc]
                k = base[doc] + -(-pos // width)
                ok = live[k]
                if min_words >= 2 * width:  # an aligned window holds two whole blocks
                    ok &= (pos % width != 0) | live[k + 1]
                w, doc, pos = w[ok], doc[ok], pos[ok]
                if not len(w):
                    continue
                h = span_hashes(data, s, e)
                grams = window_hashes(h, np.arange(len(h) - width + 1), width, 1)
                low = grams[w]
                for j in range(1, min_words - width + 1):
                    low = np.minimum(low, grams[w + j])
                parts.append((low, window_hashes(h, w, min_words), (window_hashes(h, w, min_words, 2) >> _U(32)).astype(np.uint32), ids[at + doc], vers[at + doc], pos.astype(np.int32)))
                size += len(w) * 40
                if size >= PACK_BYTES:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)

    return run


def span_spread(ids: np.ndarray) -> np.ndarray:
    from ._text import mix

    return mix(ids.astype(np.uint64))


def _repeats(table: pa.Table) -> pa.Table:
    cols = [unpack_columns(x, "<u8", "<u4", "<i8", "<i8", "<i4") for x in table["firsts"].to_pylist()]
    (_, _, ids, vers, starts), _, later = _keep_first(*(np.concatenate(x) for x in zip(*cols, strict=True)))
    rid, rver, rstart, rlen = _runs(ids[later], vers[later], starts[later])
    more = [unpack_columns(x, "<i8", "<i8", "<i4", "<i4") for x in table["repeats"].to_pylist()]
    return pa.table({
        "_id": np.concatenate([rid.astype(np.int64), *(m[0] for m in more)]),
        "_ver": np.concatenate([rver.astype(np.int64), *(m[1] for m in more)]),
        "_start": np.concatenate([rstart, *(m[2] for m in more)]).astype(np.int32),
        "_len": np.concatenate([rlen, *(m[3] for m in more)]).astype(np.int32),
    })


# -- step 3 ----------------------------------------------------------------
def _zip_texts(batches):
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = pa.array([None if t is None else z.compress(t) for t in batch.column("_text").cast(pa.binary()).to_pylist()], pa.binary())
        own = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in own), texts], names=[*own, "_z"])


def cut_words(text: bytes, starts: list[int], lengths: list[int], width: int) -> tuple[bytes, int]:
    """The text without the words of [start, start + length + width - 1), and how many they were."""
    data = np.frombuffer(text, np.uint8)
    s, e, _ = word_spans(data, np.array([0, len(data)]), NOT_SPACE)
    edge = np.zeros(len(s) + 1, np.int32)
    for a, n in zip(starts, lengths, strict=True):
        if a < len(s):
            edge[a] += 1
            edge[min(len(s), a + n + width - 1)] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    if not gone.any():
        return text, 0
    before = np.concatenate([[0], e[:-1]])
    flags = np.zeros(len(data) + 1, np.int32)
    np.add.at(flags, before[gone], 1)
    np.add.at(flags, e[gone], -1)
    kept = data[np.cumsum(flags[:-1]) == 0].tobytes()
    return (kept.lstrip(b" \t\n\v\f\r") if gone[0] else kept), int(gone.sum())


def _cut(min_words: int, with_text: bool):
    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            n_words, n_gone, sha, kept = [], [], [], []
            for z, starts, lengths in zip(*(batch.column(k).to_pylist() for k in ("_z", "_starts", "_lens")), strict=True):
                text = b"" if z is None else unzip.decompress(z)
                new, gone = cut_words(text, starts, lengths, min_words) if starts else (text, 0)
                words = new.split()
                n_words.append(len(words) + gone)
                n_gone.append(gone)
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if with_text:
                    kept.append(None if z is None else new.decode())
            own = [n for n in batch.schema.names if n in ("_id", "_rest")]
            cols = [*(batch.column(n) for n in own), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(sha, pa.string())]
            names = [*own, "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(kept, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _versions(docs: DataFrame, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """_id, _ver, _text and, if there are ``rest`` columns, these as _rest.

    Rows with equal (_id, _ver) have one text: _ver is a hash of it in a slot with an id that
    several texts share, and 0 (which packs to nothing) elsewhere."""
    ensure_checkpoint_dir(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("_id"), F.col(text_col).cast("string").alias("_text"), *([F.struct(*rest).alias("_rest")] if rest else []))
    slot, text_hash = F.pmod(F.xxhash64("_id"), F.lit(SLOTS)), F.xxhash64("_text")
    shared = own.groupBy("_id").agg(F.min(text_hash).alias("lo"), F.max(text_hash).alias("hi")).where("lo <> hi")
    # at most SLOTS small rows are broadcast
    shared = shared.select(slot.alias("_slot")).distinct().checkpoint()
    ver = F.when(F.col("_slot").isNotNull(), text_hash).otherwise(F.lit(0).cast("long"))
    return own.join(F.broadcast(shared), slot == F.col("_slot"), "left").select("_id", ver.alias("_ver"), "_text", *(["_rest"] if rest else []))


def repeat_runs(docs: DataFrame, min_words: int, id_col: str, text_col: str, rest: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(texts by internal key, compressed; runs of window starts that are repeats)."""
    if min_words < 2:
        raise ValueError("min_words must be 2 or more")
    width = (min_words + 1) // 2
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(64, 4 * spark_partitions(docs.sparkSession), math.ceil(size / BUCKET_BYTES)))
    bits = max(ANCHOR_BITS, min(60, size.bit_length() + 5))  # a window in a few hundred meets another by chance at most
    own = _versions(docs, id_col, text_col, rest or [])
    bare = own.select("_id", "_ver", "_text")
    packs = bare.mapInArrow(tidied(_index_and_probe(width, buckets, bits)), "bucket int, probes binary, twice binary, blocks binary")
    live = packs.groupBy("bucket").applyInArrow(tidied(_live_blocks), "_id long, _ver long, _block int")
    live = live.groupBy("_id", "_ver").agg(F.collect_set("_block").alias("_blocks"))
    zipped = lambda df: df.mapInArrow(tidied(_zip_texts), T.StructType([*(f for f in df.schema if f.name != "_text"), T.StructField("_z", T.BinaryType())]))
    near = zipped(bare).where(F.col("_z").isNotNull()).join(live.hint("shuffle_hash"), ["_id", "_ver"]).select("_id", "_ver", "_z", "_blocks")
    found = near.mapInArrow(tidied(_candidates(width, min_words, buckets)), "bucket int, firsts binary, repeats binary")
    return zipped(own), found.groupBy("bucket").applyInArrow(tidied(_repeats), "_id long, _ver long, _start int, _len int")


def _cut_rows(docs: DataFrame, min_words: int, id_col: str, text_col: str, with_text: bool, rest: list[str] | None = None) -> DataFrame:
    texts, runs = repeat_runs(docs, min_words, id_col, text_col, rest)
    runs = runs.groupBy("_id", "_ver").agg(F.collect_list(F.struct("_start", "_len")).alias("_runs"))
    own = ["_id", "_rest"] if rest else ["_id"]
    joined = texts.join(runs.hint("shuffle_hash"), ["_id", "_ver"], "left").select(
        *own, "_z", F.coalesce("_runs._start", F.array().cast("array<int>")).alias("_starts"), F.coalesce("_runs._len", F.array().cast("array<int>")).alias("_lens")
    )
    kinds = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())] + [("kept_text", T.StringType())] * with_text
    return joined.mapInArrow(tidied(_cut(min_words, with_text)), T.StructType([*joined.select(*own).schema, *(T.StructField(*k) for k in kinds)]))


def dedup_substrings(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256 (of the kept words joined by
    one space) and, if ``with_text``, kept_text: the text without the words of repeats, its layout kept."""
    out = _cut_rows(docs, min_words, id_col, text_col, with_text)
    return out.select(F.when(F.col("_id") != _NULL_ID, F.col("_id")).alias(id_col), *out.columns[1:])


def cut_repeats(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a struct of the columns of ``docs``), n_removed, kept_text of every row of ``docs``."""
    return _cut_rows(docs, min_words, id_col, text_col, True, docs.columns).select(F.col("_rest").alias("row"), "n_removed", "kept_text")
