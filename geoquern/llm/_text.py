"""Vectorised text kernels shared by the operators: Arrow strings in, numpy out.

Texts of a batch are handled as one UTF-8 buffer with document offsets.  All
hashes are deterministic across workers and runs (no Python ``hash``).
"""

from __future__ import annotations

import ctypes
import inspect
import os
import time

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Odd bases of the polynomial hashes (any odd constant works) and their inverses mod 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)

#: Bytes that belong to a word: everything but space and tab..carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of lower-case ASCII letters, digits and anything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: Documents are processed in runs of about this many bytes, to bound memory.
CHUNK_BYTES = 1 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    if buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Starts and ends (byte positions) of the words, and per document the index of its first word."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = table[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    cuts = offsets[:-1]
    cuts = cuts[cuts < n]
    before[cuts] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64): spreads the polynomial hash over all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, base: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, cached up to a bounded length."""
    known = _POWERS.get((base, inverse))
    if known is None or len(known) < n:
        step = np.full(max(n, 1 << 16), INVERSES[base] if inverse else BASES[base], np.uint64)
        step[0] = 1
        known = np.multiply.accumulate(step)
        if n <= 2 * CHUNK_BYTES:
            _POWERS[(base, inverse)] = known
    return known[:n]


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for every pair, independent of where it stands."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base), out=sums[1:])
    back = powers(len(values) + 1, base, True)
    return (sums[ends] - sums[starts]) * back[starts]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0) -> np.ndarray:
    """64-bit hash of every span of bytes."""
    h = _ranges(data.astype(np.uint64) + _U(1), starts, ends, base)
    return mix(h ^ ((ends - starts).astype(np.uint64) * _U(0x9FB21C651E98DF25)))


def windows(first_word: np.ndarray, width: int) -> np.ndarray:
    """Word indexes at which a window of ``width`` words of one document starts."""
    counts = np.diff(first_word)
    total = int(first_word[-1] - first_word[0])
    left = np.repeat(first_word[1:], counts) - np.arange(first_word[0], first_word[0] + total)
    return np.flatnonzero(left >= width) + first_word[0]


def window_hashes(words: np.ndarray, starts: np.ndarray, width: int, base: int = 0) -> np.ndarray:
    """64-bit hash of the ``width`` word hashes from each start."""
    return mix(_ranges(words, starts, starts + width, base))


def chunks(ids, column: pa.Array, size: int = CHUNK_BYTES):
    """Runs of documents of about ``size`` bytes: (first row, last row, bytes, offsets)."""
    data, offsets = utf8(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


_TRIMMED = [0.0]


def release(least: float = 0.0) -> None:
    """Gives free memory back to the system, unless that was done less than ``least`` seconds ago: a Python worker lives on
    between tasks and would keep what its largest one took."""
    now = time.monotonic()
    if now - _TRIMMED[0] < least:
        return
    _TRIMMED[0] = now
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim is not None:
        trim(0)


def tidied(f):
    """A function for ``mapInArrow`` or ``applyInArrow`` that releases memory when it has ended."""

    def through(batches):
        try:
            yield from batches
        finally:
            release()

    def run(x):
        out = f(x)
        if inspect.isgenerator(out):
            return through(out)
        release(0.5)
        return out

    return run


def spark_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark) -> None:
    """Takes the checkpoint folder from spark.checkpoint.dir of the session, unless the session has one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        import tempfile  # one process does all the work, as in tests

        folder = tempfile.mkdtemp(prefix="geoquern-checkpoint-")
    sc.setCheckpointDir(folder)
