"""N-gram Jaccard self-join of documents by chosen paths, and its classes.

A document is the set of its word shingles (``width`` words, lower-cased; a shorter text
is one shingle).  Equal sets are one node with a number of copies.  Nodes are split
recursively on sampled shared tokens (min-wise hashes of the sets): a node follows
``BRANCHES`` sampled positions per level, and those with the same token at a position
share a bucket.  Small buckets are compared by brute force.  A large bucket is split again
on further positions, unless at each of them a child would keep half of it (near copies, which
no split tells apart) or the depth is reached: then it is whole.  One such position alone says
little: texts that have no more than a line in common agree wherever a shingle of that line has
a very small hash.  Some ``PROBE`` members tell which it is (that decides how a bucket's pairs
are found, not whether), so only members of buckets that are split get rows of the next level.
Runs are repeated until a pair at the threshold meets with probability ``target_recall``.

A small bucket first drops pairs whose min-wise estimate is far below the threshold (over six
standard deviations), then the sets of the rest are compared exactly.  A pair that
agrees at an earlier small bucket of the first level is left to that one, so links count once;
buckets from deeper levels return neighbour lists, which are united.

Whole buckets that share nodes form one dense group, and a node is judged in its group once,
whatever the number of its buckets.  A group has a centre T (shingles that most of a
few members hold; any set gives right results).  A member with x shingles of T missing and y
others added costs c = x + threshold * y, and two members a, b are linked exactly if

    (1 + threshold) * (common differences from T) >= c(a) + c(b) - (1 - threshold) * |T|.

So pairs with c(a) + c(b) <= (1 - threshold) * |T| are linked: they are counted from a histogram of
the costs and joined by a star, in one row per member.  For the other pairs the
differences (not the texts) of at most ``BLOCK`` members at a time are compared exactly.

Groups send one row per member and a star of links, never pairs.  Classes are the connected
components (large star, small star), numbered by their smallest id.

Edge cases: texts without words (null, empty, signs only) are linked to nothing; a null
id counts as smaller than all others and is returned as null; repeated rows are copies; rows that
share an id (or have none) but not the text are judged each, though the classes of two of them may
have the same smallest id; ties do not occur, as every link is judged exactly; very long texts are
taken whole, a text of its own run at a time; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import ALNUM, chunks, ensure_checkpoint_dir, lower_ascii, mix, span_hashes, tidied, window_hashes, windows, word_spans

NULL_ID = -(1 << 63)
LONE = -(1 << 63)  # the dense group of nodes that are in none
TOKENS = 48  # min-wise hashes of a set
BRANCHES = 3
LIMIT = 512  # members of a small bucket
PROBE = 256  # members, about, that tell whether a split would leave a large bucket together
BLOCK = 4096  # members of a dense group that are compared at a time
TEXTS = 512  # members of a dense group whose texts meet its centre in one task
SAMPLE = 96  # members, about, that give a dense group its centre
BINS = 256  # of costs, up to those that no pair can have for certain
MAX_DEPTH = 4
_U = np.uint64
_MULTIPLIERS = [int(mix(np.array([i + 1], np.uint64))[0]) | 1 for i in range(TOKENS)]


def runs_for(threshold: float, target_recall: float) -> int:
    """Runs until a pair at the threshold has met with the target probability, at any depth."""
    p = 1.0
    for _ in range(MAX_DEPTH):
        p = 1 - (1 - threshold * p) ** BRANCHES
    runs = math.ceil(math.log(max(1 - target_recall, 1e-12)) / math.log(1 - p)) if p < 1 else 1
    return max(1, min(runs, TOKENS // BRANCHES))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document, sorted within it, and offsets by document."""
    data = lower_ascii(data)
    s, e, first = word_spans(data, offsets, ALNUM)
    n = np.diff(first)
    words = span_hashes(data, s, e)
    w = windows(first, width) if len(s) else np.zeros(0, np.int64)
    h = window_hashes(words, w, width)
    doc = np.searchsorted(first, w, "right") - 1
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        parts = [mix(window_hashes(words, first[d : d + 1], int(n[d])) + _U(int(n[d]))) for d in short]
        h, doc = np.concatenate([h, *parts]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """TOKENS min-wise hashes of every set (empty sets: zeros)."""
    out = np.zeros((len(first) - 1, TOKENS), np.uint32)
    some = np.diff(first) > 0
    if some.any():
        at = first[:-1][some]
        for k, a in enumerate(_MULTIPLIERS):
            out[some, k] = np.minimum.reduceat(h * _U(a), at) >> _U(32)
    return out


def set_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, whatever their order."""

    def total(x):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return (c[first[1:]] - c[first[:-1]]).view(np.int64)

    return total(mix(h)), total(mix(h ^ _U(0xA5A5A5A5DEADBEEF)))


def _sketch(width: int):
    def run(batches):
        for batch in batches:
            k1, k2, n, sig = [], [], [], []
            for _, _, data, offsets in chunks(None, batch.column(2)):
                h, first = shingles(data, offsets, width)
                a, b = set_keys(h, first)
                k1.append(a)
                k2.append(b)
                n.append(np.diff(first))
                sig += [x.tobytes() for x in signatures(h, first)]
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cat(k1), cat(k2), cat(n), pa.array(sig, pa.binary())], names=["_id", "_h", "_k1", "_k2", "_n", "_sig"])

    return run


def _tokens(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _roots(positions: int):
    """Paths of the first level: one for each position."""

    def run(batches):
        for batch in batches:
            sig = _tokens(batch.column(1))
            if not len(sig):
                continue
            path = mix(sig[:, :positions].astype(np.uint64) + (np.arange(positions, dtype=np.uint64)[None, :] + _U(1) << _U(40)))
            pos = np.broadcast_to(np.arange(positions, dtype=np.int32), path.shape).reshape(-1)
            rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), positions)
            yield pa.RecordBatch.from_arrays([pa.array(path.reshape(-1).view(np.int64)), pa.array(pos), pa.array(rep, pa.int64())], names=["path", "pos", "rep"])

    return run


def _children(batches):
    """Paths of the next level: BRANCHES positions chosen by the path."""
    for batch in batches:
        if not batch.num_rows:
            continue
        path = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        sig = _tokens(batch.column(3))
        rows = np.arange(len(sig))
        out, at = [], (mix(path) % _U(TOKENS)).astype(np.int64)
        stride = (mix(path ^ _U(77)) % _U(TOKENS // 2 - 1)).astype(np.int64) * 2 + 1
        stride[stride % 3 == 0] += 2
        for j in range(BRANCHES):
            p = (at + j * stride) % TOKENS
            out.append(mix(mix(path + _U(j + 1)) ^ sig[rows, p].astype(np.uint64)).view(np.int64))
        n = len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(out)), pa.array(np.tile(path.view(np.int64), BRANCHES)), pa.array(np.tile(batch.column(1).to_numpy(zero_copy_only=False), BRANCHES), pa.int64()), pa.array(np.repeat(np.arange(BRANCHES, dtype=np.int32), n)), pa.array(np.tile(batch.column(2).to_numpy(zero_copy_only=False), BRANCHES), pa.int64())],
            names=["path", "parent", "parent_n", "branch", "rep"],
        )


def _agree_before(sig: np.ndarray, mask: np.ndarray, pos: int, rows: np.ndarray, positions: int) -> np.ndarray:
    """Pairs (rows x all) that meet at an earlier small bucket."""
    out = np.zeros((len(rows), len(sig)), bool)
    for p in range(positions if pos < 0 else pos):
        whole = (mask >> p) & 1 == 1
        out |= (sig[rows, p][:, None] == sig[None, :, p]) & whole[rows][:, None] & whole[None, :]
    return out


def _roots_of(k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of every component of a small graph."""
    root = np.arange(k)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _likely(threshold: float, positions: int):
    """Step 1 in a bucket: members with a partner that the estimate does not exclude, by component."""
    sd = math.sqrt(threshold * (1 - threshold) / TOKENS)
    least = max(1, math.floor(TOKENS * (threshold - 6.5 * sd)))

    def run(table: pa.Table) -> pa.Table:
        sig = _tokens(table["_sig"])
        rep, n, mask, dense = (table[c].to_numpy() for c in ("rep", "_n", "mask", "dense"))
        order = np.argsort(rep, kind="stable")
        sig, rep, n, mask, dense = sig[order], rep[order], n[order], mask[order], dense[order]
        pos = table["pos"][0].as_py()
        rows = np.arange(len(rep))
        ok = (rows[:, None] < rows[None, :]) & ((dense[:, None] != dense[None, :]) | (dense[:, None] == LONE))
        ok &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :])
        if pos:
            ok &= ~_agree_before(sig, mask, pos, rows, positions)
        a, b = np.nonzero(ok)
        near = [(sig[a[at : at + (1 << 18)]] == sig[b[at : at + (1 << 18)]]).sum(1) >= least for at in range(0, len(a), 1 << 18)]
        near = np.concatenate(near) if near else np.zeros(0, bool)
        a, b = a[near], b[near]
        root = _roots_of(len(rep), a, b)
        hit = np.zeros(len(rep), bool)
        hit[a], hit[b] = True, True
        path = _U(table["path"][0].as_py() & (1 << 64) - 1)
        with np.errstate(over="ignore"):
            key = mix(rep[root].astype(np.int64).view(np.uint64) + mix(np.array([path]))[0])
        k = int(hit.sum())
        return pa.table({
            "rep": rep[hit], "_id": table["low"].to_numpy()[order][hit], "_h": table["low_h"].to_numpy()[order][hit], "vkey": key.view(np.int64)[hit], "pos": np.full(k, pos, np.int32),
            "mask": mask[hit].astype(np.int64), "dense": dense[hit].astype(np.int64), "_k1": table["_k1"].to_numpy()[order][hit], "copies": table["copies"].to_numpy()[order][hit],
        })

    return run


def overlaps(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Exact sizes of all intersections of some sets (sorted distinct hashes, offsets)."""
    k = len(first) - 1
    doc = np.repeat(np.arange(k), np.diff(first))
    order = np.argsort(h, kind="stable")
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = hs[1:] != hs[:-1]
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1  # a shingle of one set only joins nothing
    ds, col = ds[shared], np.unique(col[shared], return_inverse=True)[1]
    out = np.zeros((k, k), np.float64)
    wide = max(1, (1 << 23) // max(1, k))
    total = int(col[-1]) + 1 if len(col) else 0
    for lo in range(0, total, wide):
        a, b = np.searchsorted(col, [lo, lo + wide])
        m = np.zeros((k, min(wide, total - lo)), np.float32)
        m[ds[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    return out


def _zipped_sets(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of compressed texts, and offsets by text."""
    unzip = zstandard.ZstdDecompressor()
    texts = pa.array([unzip.decompress(z) for z in column.to_pylist()], pa.large_binary()).cast(pa.large_string())
    parts = [shingles(data, offsets, width) for _, _, data, offsets in chunks(None, texts)]
    sizes = [np.diff(first) for _, first in parts]
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat([h for h, _ in parts], np.uint64), np.concatenate([[0], np.cumsum(cat(sizes, np.int64))]).astype(np.int64)


def _verify(width: int, threshold: float, positions: int):
    """Step 2 in a candidate group: exact Jaccard; per member its links and the smallest member it is joined with."""

    def run(table: pa.Table) -> pa.Table:
        h, first = _zipped_sets(table["_z"], width)
        n = np.diff(first)
        rep, k1, copies, mask, dense = (table[c].to_numpy() for c in ("rep", "_k1", "copies", "mask", "dense"))
        # repeated rows go
        right = set_keys(h, first)[0] == k1
        keep = np.flatnonzero(right)
        keep = keep[np.sort(np.unique(rep[keep], return_index=True)[1])]
        keep = keep[np.argsort(rep[keep], kind="stable")]
        h = np.concatenate([h[first[i] : first[i + 1]] for i in keep]) if len(keep) else h[:0]
        n, rep, copies, mask, dense = n[keep], rep[keep], copies[keep], mask[keep], dense[keep]
        first = np.concatenate([[0], np.cumsum(n)])
        pos = table["pos"][0].as_py()
        inter = overlaps(h, first)
        rows = np.arange(len(rep))
        ok = (rows[:, None] < rows[None, :]) & ((dense[:, None] != dense[None, :]) | (dense[:, None] == LONE)) & (inter >= threshold * (n[:, None] + n[None, :] - inter) - 1e-9)
        if pos and len(rep):
            ok &= ~_agree_before(signatures(h, first), mask, pos, rows, positions)
        a, b = np.nonzero(ok)
        root = _roots_of(len(rep), a, b)
        both = ok | ok.T
        deep = pos < 0
        part = np.zeros(len(rep), np.int64) if deep else both @ copies
        peers = [[{"rep": int(rep[j]), "copies": int(copies[j])} for j in np.flatnonzero(both[i])] if deep else [] for i in rows]
        some = both.any(1)
        kind = pa.list_(pa.struct([("rep", pa.int64()), ("copies", pa.int64())]))
        return pa.table({"rep": rep[some], "root": rep[root][some], "links": part[some].astype(np.int64), "peers": pa.array([p for p, s in zip(peers, some, strict=True) if s], kind)})

    return run


def _zip(batches):
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([z.compress(t) for t in batch.column(2).cast(pa.binary()).to_pylist()], pa.binary())], names=["_id", "_h", "_z"])


def components(edges: DataFrame) -> DataFrame:
    """(a, root) of every node but the roots: alternating large and small stars on edges (a, b).

    Every round is written to the checkpoint folder; rounds grow with the logarithm of the size."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    sign = None
    while True:
        sym = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = sym.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(low, "a")
        e = pairs.select("a", F.col("m").alias("b")).union(pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct().checkpoint()
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == sign or now[0] == 0:
            return e.select("a", F.col("b").alias("root"))
        sign = now


def _buckets(nodes: DataFrame, positions: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(members of small buckets, small buckets of the first level by node as a bit mask of positions, members of whole buckets)."""
    rows = nodes.select("rep", "_sig").mapInArrow(tidied(_roots(positions)), "path long, pos int, rep long")
    count = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = rows.join(count, "path").checkpoint()
    small = live.where(F.col("n") <= LIMIT)
    large = live.where(F.col("n") > LIMIT)
    done, whole, sigs = [small], None, nodes.select("rep", "_sig")
    split = lambda rows: rows.join(sigs, "rep").select("path", "n", "rep", "_sig").mapInArrow(tidied(_children), "path long, parent long, parent_n long, branch int, rep long")
    for depth in range(MAX_DEPTH):
        if large.isEmpty():
            break
        dense = large
        if depth == 0:
            sigs = sigs.join(large.select("rep").distinct(), "rep", "left_semi").checkpoint()  # all later levels have nodes of the first
        if depth < MAX_DEPTH - 1:
            drawn = large.where(F.pmod(F.xxhash64("rep", "path"), F.greatest(F.lit(1), F.floor(F.col("n") / PROBE))) == 0)
            sizes = split(drawn).groupBy("parent", "branch", "path").agg(F.count(F.lit(1)).alias("n"))
            stays = sizes.groupBy("parent", "branch").agg(F.max("n").alias("top"), F.sum("n").alias("all")).where("2 * top >= all")  # the branches of which a child keeps half
            keeps = stays.groupBy("parent").agg(F.count(F.lit(1)).alias("branches")).where(F.col("branches") == BRANCHES).select(F.col("parent").alias("path")).checkpoint()
            dense = large.join(keeps, "path", "left_semi")
        whole = dense.select("path", "rep") if whole is None else whole.unionByName(dense.select("path", "rep"))
        if depth == MAX_DEPTH - 1:
            break
        kids = split(large.join(keeps, "path", "left_anti")).select("path", "rep").checkpoint()
        per = kids.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        kids = kids.join(per, "path").select("path", F.lit(-1).alias("pos"), "rep", "n").checkpoint()
        done.append(kids.where(F.col("n") <= LIMIT))
        large = kids.where(F.col("n") > LIMIT)
    members = None
    for part in done:
        part = part.select("path", "pos", "rep")
        members = part if members is None else members.unionByName(part)
    mask = small.groupBy("rep").agg(F.expr("bit_or(shiftleft(1L, pos))").alias("mask"))
    return members, mask, whole


# -- dense groups ----------------------------------------------------------
def _centre(width: int):
    """The shingles that more than half of some members hold."""

    def run(table: pa.Table) -> pa.Table:
        h, _ = _zipped_sets(table["_z"], width)
        values, n = np.unique(h, return_counts=True)
        return pa.table({"dense": table["dense"][:1], "centre": pa.array([values[2 * n > table.num_rows].tobytes()], pa.binary())})

    return run


def differences(h: np.ndarray, first: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every set: how many of the centre (sorted) it lacks and how many others it has; the differences and their offsets."""
    diffs, lack, more = [], np.zeros(len(first) - 1, np.int64), np.zeros(len(first) - 1, np.int64)
    for i in range(len(first) - 1):
        own = h[first[i] : first[i + 1]]
        d = np.setxor1d(own, centre, assume_unique=True)
        diffs.append(d)
        same = (len(own) + len(centre) - len(d)) // 2
        lack[i], more[i] = len(centre) - same, len(own) - same
    sizes = np.array([len(d) for d in diffs], np.int64)
    return lack, more, np.concatenate(diffs) if diffs else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _differences(width: int, threshold: float):
    """Some members of a dense group and its centre (the row without a node): missing, added, bin of the cost (rounded up) and the differences."""

    def run(table: pa.Table) -> pa.Table:
        is_node = pa.compute.is_valid(table["rep"])
        centre = np.frombuffer(table["_z"].filter(pa.compute.invert(is_node))[0].as_py(), np.uint64)
        table = table.filter(is_node)
        names = ["dense", "rep", "copies", "size", "lack", "more", "bin", "diff"]
        kinds = [pa.int64()] * 6 + [pa.int32(), pa.binary()]
        parts = []
        for at in range(0, table.num_rows, 64):
            rows = table.slice(at, 64)
            h, first = _zipped_sets(rows["_z"], width)
            lack, more, d, ends = differences(h, first, centre)
            room = (1 - threshold) * len(centre)
            bins = np.ceil(BINS * (lack + threshold * more) / room - 1e-9) if room > 0 else np.full(len(lack), np.inf)
            blobs = [d[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
            parts.append(pa.table([rows["dense"], rows["rep"], rows["copies"], np.full(len(lack), len(centre)), lack, more, np.minimum(bins, BINS + 1).astype(np.int32), pa.array(blobs, pa.binary())], names=names))
        return pa.concat_tables(parts) if parts else pa.schema(zip(names, kinds, strict=True)).empty_table()

    return run


def common(h: np.ndarray, first: np.ndarray, tile: int = 256):
    """(rows, sizes of their intersections with all sets), exactly, some rows at a time.

    Values that many sets hold go through matrix products, rare ones through their lists."""
    k = len(first) - 1
    doc = np.repeat(np.arange(k), np.diff(first))
    value = np.unique(h, return_inverse=True)[1]
    n = np.bincount(value) if len(value) else np.zeros(0, np.int64)
    often = n > max(32, k // 64)
    frequent = np.flatnonzero(often)
    at = np.full(len(n), -1)
    at[frequent] = np.arange(len(frequent))
    order = np.argsort(value, kind="stable")  # entries by value: the lists
    lists, list_start = doc[order], np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    in_wide = often[value] if len(value) else np.zeros(0, bool)
    rare = ~in_wide & (n[value] > 1) if len(value) else in_wide
    step = max(1, (1 << 22) // max(1, k))
    for lo in range(0, k, tile):
        hi = min(k, lo + tile)
        out = np.zeros((hi - lo, k))
        for c in range(0, len(frequent), step):
            m = np.zeros((k, min(step, len(frequent) - c)), np.float32)
            e = np.flatnonzero(in_wide & (at[value] >= c) & (at[value] < c + step))
            m[doc[e], at[value[e]] - c] = 1
            out += m[lo:hi] @ m.T
        e = np.flatnonzero(rare[first[lo] : first[hi]]) + first[lo]
        while len(e):
            upto = max(1, int(np.searchsorted(np.cumsum(n[value[e]]), 1 << 20, "right")))
            now, e = e[:upto], e[upto:]
            c = n[value[now]]
            ends = np.cumsum(c)
            mates = lists[np.repeat(list_start[value[now]] - (ends - c), c) + np.arange(ends[-1])]
            out += np.bincount(np.repeat(doc[now] - lo, c) * k + mates, minlength=out.size).reshape(out.shape)
        yield np.arange(lo, hi), out


def _compare(threshold: float):
    """Two blocks of a dense group: exact links of the pairs that costs alone do not decide."""

    def run(table: pa.Table) -> pa.Table:
        rep, copies, size, lack, more, bins, own = (table[c].to_numpy() for c in ("rep", "copies", "size", "lack", "more", "bin", "own"))
        cross = table["lo"][0].as_py() != table["hi"][0].as_py()
        raw = table["diff"].to_pylist()
        h = np.frombuffer(b"".join(raw), np.uint64)
        first = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])]).astype(np.int64)
        n = size - lack + more
        links, left, right = np.zeros(len(rep), np.int64), [], []
        for rows, same in common(h, first):
            inter = size[rows][:, None] - lack[rows][:, None] - lack[None, :] + same
            ok = inter >= threshold * (n[rows][:, None] + n[None, :] - inter) - 1e-9
            ok &= bins[rows][:, None] + bins[None, :] > BINS
            ok &= own[rows][:, None] != own[None, :] if cross else rows[:, None] != np.arange(len(rep))[None, :]
            links[rows] = ok @ copies
            a, b = np.nonzero(ok)
            left.append(np.arange(len(rep)))
            right.append(_roots_of(len(rep), rows[a], b))
        root = _roots_of(len(rep), np.concatenate(left), np.concatenate(right))
        some = links > 0
        kind = pa.list_(pa.struct([("rep", pa.int64()), ("copies", pa.int64())]))
        return pa.table({"rep": rep[some], "root": rep[root][some], "links": links[some], "peers": pa.array([[]] * int(some.sum()), kind)})

    return run


def _dense_groups(whole: DataFrame) -> DataFrame:
    """rep, dense: the group of every node of a whole bucket; buckets that share a node are of one group."""
    home = whole.groupBy("rep").agg(F.min("path").alias("home"))
    roots = components(whole.join(home, "rep").select(F.col("path").alias("a"), F.col("home").alias("b")))  # a graph of buckets, not of nodes
    return home.join(roots, F.col("home") == F.col("a"), "left").select("rep", F.coalesce("root", "home").alias("dense")).checkpoint()


def _dense_links(groups: DataFrame, members: DataFrame, width: int, threshold: float) -> DataFrame:
    """rep, root, links, peers (none) of the links within dense groups, each once; ``members``: dense, rep, copies, _z."""
    count = groups.groupBy("dense").agg(F.count(F.lit(1)).alias("m")).checkpoint()
    parts = lambda size: F.ceil(F.col("m") / size).cast("int")
    part = lambda size, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), parts(size)).cast("int")
    each = lambda size: F.explode(F.sequence(F.lit(0), parts(size) - 1)).alias("part")
    sized = members.join(count, "dense")
    drawn = sized.where(F.pmod(F.xxhash64("rep", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("m") / SAMPLE))) == 0)
    centres = drawn.select("dense", "_z").groupBy("dense").applyInArrow(tidied(_centre(width)), "dense long, centre binary")
    # a group of which no member was drawn has the empty centre
    centres = count.join(centres, "dense", "left").select("dense", each(TEXTS), F.coalesce("centre", F.lit(b"")).alias("_z"))
    none = F.lit(None).cast("long")
    meet = sized.select("dense", part(TEXTS, 2).alias("part"), "rep", "copies", "_z").unionByName(centres.select("dense", "part", none.alias("rep"), none.alias("copies"), "_z"))
    diffs = meet.groupBy("dense", "part").applyInArrow(tidied(_differences(width, threshold)), "dense long, rep long, copies long, size long, lack long, more long, bin int, diff binary").checkpoint()
    # pairs that costs alone decide
    sure = diffs.where(F.col("bin") <= BINS).select("dense", "rep", "copies", "bin")
    costs = sure.groupBy("dense", "bin").agg(F.sum("copies").alias("n"), F.min("rep").alias("rep"))
    costs = costs.groupBy("dense").agg(F.min(F.struct("bin", "rep")).alias("hub"), F.collect_list(F.struct("bin", "n")).alias("costs"))  # at most BINS + 1 a group
    side = costs.join(count, "dense").select("dense", "costs", "hub", each(BLOCK))
    near = sure.join(count, "dense").withColumn("part", part(BLOCK, 3)).join(side, ["dense", "part"]).where(F.col("bin") + F.col("hub.bin") <= BINS)
    partners = F.aggregate("costs", F.lit(0).cast("long"), lambda s, x: s + F.when(x["bin"] + F.col("bin") <= BINS, x["n"]).otherwise(F.lit(0)))
    partners = partners - F.when(2 * F.col("bin") <= BINS, F.col("copies")).otherwise(F.lit(0))
    star = near.select("rep", F.col("hub.rep").alias("root"), partners.alias("links"), F.array().cast("array<struct<rep:long,copies:long>>").alias("peers"))
    # the others, in pairs of blocks; a member without differences has only pairs that its cost decides
    own = part(BLOCK, 3)
    pairs = F.transform(F.sequence(F.lit(0), parts(BLOCK) - 1), lambda j: F.struct(F.least(own, j).alias("lo"), F.greatest(own, j).alias("hi")))
    blocks = diffs.where(F.length("diff") > 0).join(count, "dense").withColumn("own", own).withColumn("b", F.explode(pairs)).select("dense", "b.lo", "b.hi", "own", *(c for c in diffs.columns if c != "dense"))
    return star.unionByName(blocks.groupBy("dense", "lo", "hi").applyInArrow(tidied(_compare(threshold)), FOUND))


FOUND = "rep long, root long, links long, peers array<struct<rep:long,copies:long>>"


def _classes(docs: DataFrame, width: int = 5, threshold: float = 0.8, target_recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _h (a hash of the text), _n, head (the _id and _h that stand for the class; null without words), n_links of every row."""
    if not 0 < threshold <= 1 or width < 1:
        raise ValueError("threshold must be in (0, 1], width at least 1")
    ensure_checkpoint_dir(docs.sparkSession)
    positions = BRANCHES * runs_for(threshold, target_recall)
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_h"), F.col(text_col).cast("string").alias("_text"))
    sketch = own.mapInArrow(tidied(_sketch(width)), "_id long, _h long, _k1 long, _k2 long, _n long, _sig binary").checkpoint()
    nodes = sketch.where("_n > 0").groupBy("_k1", "_k2", "_n").agg(F.min(F.struct("_id", "_h")).alias("head"), F.count(F.lit(1)).alias("copies"), F.first("_sig").alias("_sig"))
    # a node is named by a number of its own, as rows of several nodes may share an id; the checkpoint holds it fast
    nodes = nodes.select("_k1", "_k2", "_n", F.monotonically_increasing_id().alias("rep"), F.col("head._id").alias("low"), F.col("head._h").alias("low_h"), "copies", "_sig").checkpoint()
    members, mask, whole = _buckets(nodes, positions)
    texts = own.where(F.col("_text").isNotNull()).mapInArrow(tidied(_zip), "_id long, _h long, _z binary")
    lone = F.lit(LONE)
    groups = None if whole is None else _dense_groups(whole)
    marked = nodes.withColumn("dense", lone) if groups is None else nodes.join(groups, "rep", "left").withColumn("dense", F.coalesce("dense", lone))
    full = members.join(marked.select("rep", "low", "low_h", "_sig", "_n", "_k1", "copies", "dense"), "rep").join(mask, "rep", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    likely = full.groupBy("path").applyInArrow(tidied(_likely(threshold, positions)), "rep long, _id long, _h long, vkey long, pos int, mask long, dense long, _k1 long, copies long")
    if groups is not None:  # all texts are dealt out once, for the small buckets and the dense groups
        every = groups.join(nodes, "rep").select("rep", F.col("low").alias("_id"), F.col("low_h").alias("_h"), F.lit(None).cast("long").alias("vkey"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("mask"), "dense", "_k1", "copies")
        likely = likely.unionByName(every)
    candidates = texts.join(likely.hint("shuffle_hash"), ["_id", "_h"])
    if groups is None:
        found = candidates.groupBy("vkey").applyInArrow(tidied(_verify(width, threshold, positions)), FOUND).checkpoint()
    else:
        candidates = candidates.checkpoint()
        found = candidates.where(F.col("vkey").isNotNull()).groupBy("vkey").applyInArrow(tidied(_verify(width, threshold, positions)), FOUND)
        dense = candidates.where(F.col("vkey").isNull()).groupBy("dense", "rep", "copies").agg(F.first("_z").alias("_z"))  # repeated rows go
        found = found.unionByName(_dense_links(groups, dense, width, threshold)).checkpoint()
    peers = F.array_distinct(F.flatten(F.collect_list("peers")))
    links = found.groupBy("rep").agg((F.sum("links") + F.aggregate(peers, F.lit(0).cast("long"), lambda s, x: s + x["copies"])).alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    roots = roots.union(roots.select(F.col("root").alias("a"), "root").distinct())
    heads = roots.join(nodes.select("rep", "low", "low_h"), F.col("a") == F.col("rep")).groupBy("root").agg(F.min(F.struct("low", "low_h")).alias("first"))
    roots = roots.join(heads, "root").select("a", "first")
    named = nodes.select("_k1", "_k2", "_n", "rep", "low", "low_h", "copies").join(links, "rep", "left").join(roots, F.col("rep") == F.col("a"), "left")
    head = F.struct(F.coalesce("first.low", "low").alias("_id"), F.when(F.col("first").isNotNull(), F.col("first.low_h")).otherwise(F.col("low_h")).alias("_h"))
    named = named.select("_k1", "_k2", "_n", head.alias("head"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = sketch.select("_id", "_h", "_k1", "_k2", "_n").join(named, ["_k1", "_k2", "_n"], "left")
    return out.select("_id", "_h", "_n", "head", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_classes(docs: DataFrame, width: int = 5, threshold: float = 0.8, target_recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id (smallest id of the class), n_links (other rows with a Jaccard similarity of at least the threshold)."""
    out = _classes(docs, width, threshold, target_recall, id_col, text_col)
    class_id = F.coalesce("head._id", "_id")
    return out.select(F.when(F.col("_id") != NULL_ID, F.col("_id")).alias(id_col), F.when(class_id != NULL_ID, class_id).alias("class_id"), "n_links")


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stand for their class (the smallest id), one of repeated rows; all rows without words."""
    own, text_hash = "__head_id", "__head_hash"  # names that no column of docs has
    while {own, text_hash} & set(docs.columns):
        own, text_hash = own + "_", text_hash + "_"
    heads = _classes(docs, id_col=id_col, text_col=text_col, **how).where((F.col("_n") == 0) | (F.struct("_id", "_h") == F.col("head")))
    heads = heads.groupBy(F.col("_id").alias(own), F.col("_h").alias(text_hash)).agg(((F.max("_n") > 0) & (F.count(F.lit(1)) > 1)).alias("again")).checkpoint()
    keyed = docs.withColumns({own: F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), text_hash: F.xxhash64(F.col(text_col).cast("string"))})
    kept = lambda again: keyed.join(heads.where(F.col("again") == again).hint("shuffle_hash"), [own, text_hash], "left_semi").select(*docs.columns)
    return kept(False).unionByName(kept(True).dropDuplicates([id_col, text_col]))
