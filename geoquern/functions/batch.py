"""Whole-batch forms of the functions met most, in numpy.

``run`` takes rows with a null out and deals with rows of one shape (the lengths of their geometries) at a time.
Within such a group a form works on canonical points, lines and polygons of one ring; where it
meets anything else (other types, mixed SRIDs, what would be an error) it returns None, or marks the rows in
question, and those run through the row-wise kernel: results and errors are the same.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..core import codec, crs
from ..core import model as M
from ..core import planar as P
from ..core.model import GeometryError
from .geodesic import RADIUS

_HEAD = [0, 1, 2, 3, 8, 9, 10, 11, 12]  # bytes that tell the type: header without SRID, byte order and type
_KINDS = {M.POINT: (b"GP\x00\x01\x01\x01\x00\x00\x00", 13), M.LINESTRING: (b"GP\x00\x01\x01\x02\x00\x00\x00", 17), M.POLYGON: (b"GP\x00\x01\x01\x03\x00\x00\x00", 21)}
#: Rows of one shape below which the row-wise kernel is as good.
FEW = 4


def run(name: str, columns: tuple[pa.Array, ...], rows):
    """The values of a function over columns, or None if it has no whole-batch form; ``rows`` computes columns row by row."""
    whole = BATCH.get(name)
    n = len(columns[0]) if columns else 0
    if whole is None or n == 0:
        return None
    if any(c.null_count for c in columns):
        valid = np.ones(n, bool)
        for c in columns:
            valid &= c.is_valid().to_numpy(zero_copy_only=False)
        if not valid.any():
            return pa.nulls(n)
        mask = pa.array(valid)
        some = tuple(c.filter(mask) for c in columns)
        out = run(name, some, rows)
        at = pa.array(np.cumsum(valid) - 1, mask=~valid)
        return (rows(*some) if out is None else out).take(at)
    shape = None
    for c in columns:
        if pa.types.is_binary(c.type):
            own = np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + n + 1]).astype(np.int64)
            shape = own if shape is None else shape << 32 | own
    if shape is None or (shape == shape[0]).all():
        return _group(whole, columns, rows)
    shapes, group = np.unique(shape, return_inverse=True)
    if len(shapes) * FEW > n:
        return None
    order = np.argsort(group, kind="stable")
    parts = []
    for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        own = tuple(c.take(pa.array(at)) for c in columns)
        out = _group(whole, own, rows) if len(at) >= FEW else None
        parts.append(rows(*own) if out is None else out)
    kind = next(p.type for p in parts)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return pa.concat_arrays([p.cast(kind) for p in parts]).take(pa.array(back))


def _group(whole, columns, rows):
    out = whole(*columns)
    if not isinstance(out, tuple):
        return out
    values, left = out  # some rows are left to the row-wise kernel
    if not left.any():
        return values
    if left.mean() > 0.8:
        return None
    own = rows(*(c.filter(pa.array(left)) for c in columns))
    at = np.arange(len(left))
    at[left] = len(left) + np.arange(int(left.sum()))
    return pa.concat_arrays([values.cast(own.type), own]).take(pa.array(at))


def _rows(column: pa.Array, least: int) -> np.ndarray | None:
    """The values as a matrix of bytes if all have one length."""
    n = len(column)
    if n == 0 or column.null_count or not pa.types.is_binary(column.type):
        return None
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1]
    size = int(at[1] - at[0])
    if size < least or (np.diff(at) != size).any():
        return None
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(n, size)


def _floats(rows: np.ndarray, start: int) -> np.ndarray:
    return np.ascontiguousarray(rows[:, start:]).view("<f8")


def _srids(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, 4:8]).view("<i4")[:, 0]


def shaped(column: pa.Array):
    """(kind, rows of bytes, where coordinates start, x and y matrices) of points, lines or polygons of one ring, or None."""
    rows = _rows(column, 29)
    if rows is None:
        return None
    first = rows[0, _HEAD].tobytes()
    kind = next((k for k, (head, _) in _KINDS.items() if head == first), None)
    if kind is None or (rows[:, _HEAD] != rows[0, _HEAD]).any():
        return None
    start = _KINDS[kind][1]
    n, rest = divmod(rows.shape[1] - start, 16)
    if rest or n < 1 or (kind == M.POINT and n != 1):
        return None
    if kind != M.POINT:
        count = np.ascontiguousarray(rows[:, start - 4 : start]).view("<u4")[:, 0]
        if (count != n).any() or (kind == M.POLYGON and (np.ascontiguousarray(rows[:, 13:17]).view("<u4")[:, 0] != 1).any()):
            return None
    v = _floats(rows, start)
    x, y = v[:, 0::2], v[:, 1::2]
    return None if kind == M.POINT and np.isnan(x).any() else (kind, rows, start, x, y)


def points(column: pa.Array):
    """(x, y, srid) of a column of points, or None."""
    g = shaped(column)
    return (g[3][:, 0], g[4][:, 0], _srids(g[1])) if g and g[0] == M.POINT else None


def rings(column: pa.Array):
    """(x, y, srid) matrices of a column of polygons of one ring and one number of points, or None."""
    g = shaped(column)
    return (g[3], g[4], _srids(g[1])) if g and g[0] == M.POLYGON and g[3].shape[1] >= 4 else None


def lines(column: pa.Array):
    g = shaped(column)
    return (g[3], g[4], _srids(g[1])) if g and g[0] == M.LINESTRING else None


def _binary(rows: np.ndarray) -> pa.Array:
    n, size = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _numbers(*columns: pa.Array):
    if any(c.null_count or not (pa.types.is_floating(c.type) or pa.types.is_integer(c.type)) for c in columns) or not len(columns[0]):
        return None
    return [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]


def _encode(head: bytes, srid, coords: np.ndarray) -> pa.Array:
    n = len(coords)
    out = np.empty((n, len(head) + 8 * coords.shape[1]), np.uint8)
    out[:, : len(head)] = np.frombuffer(head, np.uint8)
    out[:, 4:8] = np.ascontiguousarray(np.broadcast_to(np.asarray(srid, "<i4"), n)).view(np.uint8).reshape(n, 4)
    out[:, len(head) :] = np.ascontiguousarray(coords.astype("<f8")).view(np.uint8).reshape(n, -1)
    return _binary(out)


def make_point(*columns):
    if len(columns) == 3 and not pa.types.is_integer(columns[2].type):
        return None  # a third ordinate
    v = _numbers(*columns)
    if v is None or np.isnan(v[0]).any() or np.isnan(v[1]).any():
        return None
    return _encode(b"GP\x00\x01" + bytes(4) + b"\x01\x01\x00\x00\x00", v[2].astype(np.int32) if len(v) > 2 else 0, np.stack(v[:2], axis=1))


def make_envelope(*columns):
    v = _numbers(*columns)
    if v is None:
        return None
    a, b, c, d = v[:4]
    return _encode(b"GP\x00\x01" + bytes(4) + b"\x01\x03\x00\x00\x00\x01\x00\x00\x00\x05\x00\x00\x00", v[4].astype(np.int32) if len(v) > 4 else 0, np.stack([a, b, a, d, c, d, c, b, a, b], axis=1))


def _ordinate(k):
    def f(column):
        p = points(column)
        return None if p is None else pa.array(p[k])

    return f


def _replaced(g, x, y, srid=None) -> pa.Array:
    """The same geometries with other coordinates (and SRID)."""
    _, rows, start, _, _ = g
    out = rows.copy()
    both = np.empty((len(rows), 2 * x.shape[1]))
    both[:, 0::2], both[:, 1::2] = x, y
    out[:, start:] = both.astype("<f8").view(np.uint8).reshape(len(rows), -1)
    if srid is not None:
        out[:, 4:8] = np.frombuffer(np.int32(srid).tobytes(), np.uint8)
    return _binary(out)


def _placed(x, y, srid) -> pa.Array:
    return _encode(b"GP\x00\x01" + bytes(4) + b"\x01\x01\x00\x00\x00", srid, np.stack([x, y], axis=1))


def _boxes(x0, y0, x1, y1, srid) -> pa.Array:
    return _encode(b"GP\x00\x01" + bytes(4) + b"\x01\x03\x00\x00\x00\x01\x00\x00\x00\x05\x00\x00\x00", srid, np.stack([x0, y0, x0, y1, x1, y1, x1, y0, x0, y0], axis=1))


def srid(column):
    g = shaped(column)
    return None if g is None else pa.array(_srids(g[1]), pa.int32())


def _constant(**by_kind):
    """A value that follows from the type and the number of points."""

    def f(column):
        g = shaped(column)
        value = by_kind.get({M.POINT: "point", M.LINESTRING: "line", M.POLYGON: "polygon"}[g[0]]) if g else None
        if value is None:
            return None
        value = value(g[3].shape[1]) if callable(value) else value
        return pa.array([value]).take(pa.array(np.zeros(len(column), np.int64)))

    return f


def _side(k, pick):
    def f(column):
        g = shaped(column)
        return None if g is None else pa.array(pick(g[3 + k], axis=1))

    return f


def _lengths(x, y):
    return np.hypot(np.diff(x, axis=1), np.diff(y, axis=1))


def _measure(kind, value):
    """A measure of one type that is 0 for the others."""

    def f(column):
        g = shaped(column)
        if g is None:
            return None
        return pa.array(value(g[3], g[4]) if g[0] == kind else np.zeros(len(column)))

    return f


def _shoelace(x, y):
    x, y = x - x[:, :1], y - y[:, :1]
    return np.abs((x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1]).sum(1) / 2)


area, length, perimeter = _measure(M.POLYGON, _shoelace), _measure(M.LINESTRING, lambda x, y: _lengths(x, y).sum(1)), _measure(M.POLYGON, lambda x, y: _lengths(x, y).sum(1))


def _end(k):
    def f(column):
        g = shaped(column)
        if g is None or g[0] == M.POLYGON:
            return None
        return _placed(g[3][:, k], g[4][:, k], _srids(g[1]))

    return f


def point_n(column, n):
    g, v = lines(column), _numbers(n)
    if g is None or v is None or (v[0] != v[0][0]).any() or not 1 <= abs(int(v[0][0])) <= g[0].shape[1]:
        return None
    k = int(v[0][0])
    return _placed(g[0][:, k - 1 if k > 0 else k], g[1][:, k - 1 if k > 0 else k], g[2])


def envelope(column):
    g = shaped(column)
    if g is None or g[0] == M.POINT:
        return column if g else None
    x0, y0, x1, y1 = g[3].min(1), g[4].min(1), g[3].max(1), g[4].max(1)
    return _boxes(x0, y0, x1, y1, _srids(g[1])), ~((x0 < x1) & (y0 < y1))


def centroid(column):
    g = shaped(column)
    if g is None or g[0] == M.POINT:
        return None
    if g[0] == M.LINESTRING:
        n = _lengths(g[3], g[4])
        w = n.sum(1)
        safe = np.where(w > 0, w, 1)
        mid = lambda v: (n * (v[:, :-1] + v[:, 1:]) / 2).sum(1) / safe
        return _placed(mid(g[3]), mid(g[4]), _srids(g[1])), ~(w > 0)
    x, y = g[3] - g[3][:, :1], g[4] - g[4][:, :1]
    cross = x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1]
    w = cross.sum(1)
    safe = np.where(w != 0, w, 1)
    mid = lambda v: (cross * (v[:, :-1] + v[:, 1:])).sum(1) / (3 * safe)
    return _placed(g[3][:, 0] + mid(x), g[4][:, 0] + mid(y), _srids(g[1])), w == 0


def _mapped(change, arguments):
    """Every vertex changed by the same rule, with numbers as arguments."""

    def f(column, *more):
        g = shaped(column)
        v = _numbers(*more) if more else []
        if g is None or v is None or len(more) != arguments:
            return None
        return _replaced(g, *change(g[3], g[4], *(u[:, None] for u in v)))

    return f


def _turn(x, y, t):
    c, s = np.cos(t), np.sin(t)
    return c * x - s * y, s * x + c * y


def transform(column, target):
    g, v = shaped(column), _numbers(target)
    if g is None or v is None:
        return None
    source, to = _srids(g[1]), v[0]
    if (source != source[0]).any() or (to != to[0]).any() or source[0] <= 0:
        return None
    try:
        x, y = crs.arrays(int(source[0]), int(to[0]))(g[3], g[4])
    except GeometryError:
        return None
    return _replaced(g, x, y, int(to[0]))


def set_srid(column, value):
    g, v = shaped(column), _numbers(value)
    if g is None or v is None:
        return None
    out = g[1].copy()
    out[:, 4:8] = np.ascontiguousarray(v[0].astype("<i4")).view(np.uint8).reshape(len(out), 4)
    return _binary(out)


def as_wkb(column):
    g = shaped(column)
    return None if g is None else _binary(g[1][:, 8:])


def from_wkb(column, *more):
    rows, v = _rows(column, 21), _numbers(*more) if more else []
    if rows is None or v is None or rows[0, 0] != 1 or (rows[:, :5] != rows[0, :5]).any() or rows[0, 1:5].tobytes() not in (b"\1\0\0\0", b"\2\0\0\0", b"\3\0\0\0"):
        return None
    out = np.zeros((len(rows), rows.shape[1] + 8), np.uint8)
    out[:, :4] = np.frombuffer(b"GP\0\1", np.uint8)
    out[:, 8:] = rows
    if v:
        out[:, 4:8] = np.ascontiguousarray(v[0].astype("<i4")).view(np.uint8).reshape(len(out), 4)
    made = _binary(out)
    return made if shaped(made) is not None else None


# -- text ------------------------------------------------------------------
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_PAIR = rf"{_NUMBER}\s+{_NUMBER}"
_LIST = rf"\(\s*{_PAIR}(?:\s*,\s*{_PAIR})*\s*\)"
_TEXTS = {M.POINT: rf"^\s*(?i:POINT)\s*\(\s*{_PAIR}\s*\)\s*$", M.LINESTRING: rf"^\s*(?i:LINESTRING)\s*{_LIST}\s*$", M.POLYGON: rf"^\s*(?i:POLYGON)\s*\(\s*{_LIST}\s*\)\s*$"}


def from_text(column, *more):
    """WKT of points, lines and polygons of one ring, of one type in a batch."""
    v = _numbers(*more) if more else []
    if v is None or not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        return None
    kind = next((k for k, p in _TEXTS.items() if pc.match_substring_regex(column.slice(0, 1), p)[0].as_py()), None)
    if kind is None or not pc.all(pc.match_substring_regex(column, _TEXTS[kind])).as_py():
        return None
    body = pc.utf8_trim_whitespace(pc.replace_substring_regex(column, r"[^-+.0-9eE]*[a-zA-Z][^-+.0-9]*\(|[\s,()]+", " "))
    words = pc.utf8_split_whitespace(body)
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    try:
        values = pc.cast(words.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    except pa.ArrowInvalid:
        return None
    least = {M.POINT: 2, M.LINESTRING: 4, M.POLYGON: 8}[kind]
    if (sizes < least).any() or (sizes % 2).any() or not np.isfinite(values).all():
        return None
    start = np.cumsum(sizes) - sizes
    if kind == M.POLYGON:
        last = start + sizes
        if ((values[start] != values[last - 2]) | (values[start + 1] != values[last - 1])).any():
            return None
    srids = v[0].astype(np.int32) if v else np.zeros(len(column), np.int32)
    parts, order = [], []
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        count = np.uint32(size // 2).tobytes()
        head = _KINDS[kind][0][:4] + bytes(4) + _KINDS[kind][0][4:] + {M.POINT: b"", M.LINESTRING: count, M.POLYGON: b"\1\0\0\0" + count}[kind]
        parts.append(_encode(head, srids[at], values[start[at][:, None] + np.arange(size)]))
        order.append(at)
    if len(parts) == 1:
        return parts[0]
    back = np.empty(len(column), np.int64)
    back[np.concatenate(order)] = np.arange(len(column))
    return pa.concat_arrays(parts).take(pa.array(back))


def _digits(v: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(v).reshape(-1)
    if (flat == np.floor(flat)).all() and (np.abs(flat) < 1e15).all() and not (np.signbit(flat) & (flat == 0)).any():
        return pc.cast(pa.array(flat.astype(np.int64)), pa.string())
    return pa.array([codec.number(x) for x in flat.tolist()], pa.string())


def _as_text(with_srid):
    def f(column):
        g = shaped(column)
        if g is None:
            return None
        kind, rows, _, x, y = g
        pairs = pc.binary_join_element_wise(_digits(x), _digits(y), " ")
        n = x.shape[1]
        if n > 1:
            pairs = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * n + 1, n), pa.int32()), pairs), ",")
        left, right = {M.POINT: ("POINT(", ")"), M.LINESTRING: ("LINESTRING(", ")"), M.POLYGON: ("POLYGON((", "))")}[kind]
        out = pc.binary_join_element_wise(left, pairs, right, "")
        own = _srids(rows)
        if with_srid and (own > 0).any():
            prefix = pa.array([f"SRID={s};" if s > 0 else "" for s in own.tolist()]) if (own != own[0]).any() else f"SRID={int(own[0])};"
            out = pc.binary_join_element_wise(prefix, out, "")
        return out

    return f


# -- lines -----------------------------------------------------------------
def make_line(a, b):
    t = _two(a, b)
    if t is None:
        return None
    p, q = t
    return _encode(b"GP\x00\x01" + bytes(4) + b"\x01\x02\x00\x00\x00\x02\x00\x00\x00", np.where(p[2] > 0, p[2], q[2]), np.stack([p[0], p[1], q[0], q[1]], axis=1))


def line_interpolate(column, t):
    g, v = lines(column), _numbers(t)
    if g is None or v is None or not ((v[0] >= 0) & (v[0] <= 1)).all():
        return None
    x, y, own = g
    n = _lengths(x, y)
    upto = np.cumsum(n, axis=1)
    want = v[0] * upto[:, -1]
    k = np.minimum((upto < want[:, None]).sum(1), n.shape[1] - 1)
    rows = np.arange(len(x))
    size = n[rows, k]
    f = np.where(size > 0, (want - (upto[rows, k] - size)) / np.where(size > 0, size, 1), 0)
    f = np.where((v[0] <= 0) | (upto[:, -1] == 0), 0, np.minimum(f, 1))
    k = np.where((v[0] <= 0) | (upto[:, -1] == 0), 0, k)
    at = lambda c: np.where(f >= 1, c[rows, k + 1], c[rows, k] + (c[rows, k + 1] - c[rows, k]) * f)
    return _placed(at(x), at(y), own)


def line_locate(column, point):
    g, p = lines(column), points(point)
    if g is None or p is None or ((g[2] > 0) & (p[2] > 0) & (g[2] != p[2])).any():
        return None
    x, y, _ = g
    dx, dy = np.diff(x, axis=1), np.diff(y, axis=1)
    square = dx * dx + dy * dy
    t = np.clip(((p[0][:, None] - x[:, :-1]) * dx + (p[1][:, None] - y[:, :-1]) * dy) / np.where(square > 0, square, 1), 0, 1)
    off = np.hypot(x[:, :-1] + t * dx - p[0][:, None], y[:, :-1] + t * dy - p[1][:, None])
    n = np.sqrt(square)
    upto = np.cumsum(n, axis=1)
    rows, k = np.arange(len(x)), off.argmin(1)
    total = upto[:, -1]
    return pa.array(np.where(total > 0, (upto[rows, k] - n[rows, k] + t[rows, k] * n[rows, k]) / np.where(total > 0, total, 1), 0))


def _two(a, b):
    p, q = points(a), points(b)
    if p is None or q is None or ((p[2] > 0) & (q[2] > 0) & (p[2] != q[2])).any():
        return None
    return p, q


def distance(a, b):
    t = _two(a, b)
    return None if t is None else pa.array(np.hypot(t[0][0] - t[1][0], t[0][1] - t[1][1]))


def dwithin(a, b, d):
    t, v = _two(a, b), _numbers(d)
    if t is None or v is None or (v[0] < 0).any():
        return None
    return pa.array(np.hypot(t[0][0] - t[1][0], t[0][1] - t[1][1]) <= v[0])


def azimuth(a, b):
    t = _two(a, b)
    if t is None:
        return None
    dx, dy = t[1][0] - t[0][0], t[1][1] - t[0][1]
    return pa.array(np.arctan2(dx, dy) % (2 * math.pi), mask=(dx == 0) & (dy == 0))


def distance_sphere(a, b):
    t = _two(a, b)
    if t is None:
        return None
    p0, p1 = np.radians(t[0][1]), np.radians(t[1][1])
    h = np.sin((p1 - p0) / 2) ** 2 + np.cos(p0) * np.cos(p1) * np.sin(np.radians(t[1][0] - t[0][0]) / 2) ** 2
    return pa.array(2 * RADIUS * np.arcsin(np.minimum(1.0, np.sqrt(h))))


def locate(x: np.ndarray, y: np.ndarray, polys) -> np.ndarray:
    """1, 0 or -1 by point: inside, on the boundary, outside.  Places too near to an edge for
    double precision are decided exactly."""
    out = np.full(len(x), -1)
    for rings_ in polys:
        inside, unsure = np.zeros(len(x), bool), np.zeros(len(x), bool)
        for ring in rings_:
            for a, b in zip(ring, ring[1:]):
                span = (min(a[1], b[1]) <= y) & (y <= max(a[1], b[1])) & (x <= max(a[0], b[0]))
                l, r = (a[0] - x) * (b[1] - y), (a[1] - y) * (b[0] - x)
                det = l - r
                unsure |= span & (np.abs(det) <= 1e-14 * (np.abs(l) + np.abs(r)))
                if a[1] != b[1]:
                    inside ^= ((a[1] > y) != (b[1] > y)) & ((det > 0) == (b[1] > a[1]))
        own = np.where(inside, 1, -1)
        for i in np.flatnonzero(unsure):
            own[i] = P.locate((float(x[i]), float(y[i])), rings_)
        out = np.maximum(out, own)
    return out


def boxes(column: pa.Array):
    """(x0, y0, x1, y1, srid, whether it is one) of axis-parallel rectangles and points, or None."""
    g = shaped(column)
    if g is None or g[0] == M.LINESTRING or not (np.isfinite(g[3]).all() and np.isfinite(g[4]).all()):
        return None
    x, y = g[3], g[4]
    x0, y0, x1, y1 = x.min(1), y.min(1), x.max(1), y.max(1)
    own = np.ones(len(x), bool)
    if g[0] == M.POLYGON:
        if x.shape[1] != 5:
            own[:] = False
        else:
            corner = ((x == x0[:, None]) | (x == x1[:, None])) & ((y == y0[:, None]) | (y == y1[:, None]))
            steps = ((x[:, 1:] == x[:, :-1]) ^ (y[:, 1:] == y[:, :-1])).all(1)  # every side runs along one axis
            turns = (x[:, 0] != x[:, 2]) & (y[:, 0] != y[:, 2]) & (x[:, 1] != x[:, 3]) & (y[:, 1] != y[:, 3])
            own = corner.all(1) & steps & turns
    return x0, y0, x1, y1, _srids(g[1]), own, g[0] == M.POINT


def _boxed(test):
    """A predicate of two rectangles, or of a rectangle and a point; pairs whose boxes are apart are decided for any areas."""

    def f(a, b):
        p, q = boxes(a), boxes(b)
        if p is None or q is None or (p[6] and q[6]) or ((p[4] > 0) & (q[4] > 0) & (p[4] != q[4])).any():
            return None
        meet = (p[0] <= q[2]) & (q[0] <= p[2]) & (p[1] <= q[3]) & (q[1] <= p[3])
        left = meet & ~(p[5] & q[5])
        return pa.array(np.where(meet, test(p, q, meet), test is _no) if test is _no else test(p, q, meet) & meet), left

    return f


def _inner(p, q):
    return (p[0] < q[2]) & (q[0] < p[2]) & (p[1] < q[3]) & (q[1] < p[3])


def _holds(p, q):
    return (p[0] <= q[0]) & (q[2] <= p[2]) & (p[1] <= q[1]) & (q[3] <= p[3])


def _no(p, q, meet):
    return ~meet


def _same(p, q, _):
    return (p[0] == q[0]) & (p[1] == q[1]) & (p[2] == q[2]) & (p[3] == q[3])


_BOXED = {
    "ST_Intersects": lambda p, q, m: m, "ST_Disjoint": _no, "ST_Covers": lambda p, q, m: _holds(p, q), "ST_CoveredBy": lambda p, q, m: _holds(q, p), "ST_Touches": lambda p, q, m: m & ~_inner(p, q),
    "ST_Contains": lambda p, q, m: _holds(p, q) & _inner(p, q), "ST_Within": lambda p, q, m: _holds(q, p) & _inner(p, q), "ST_Equals": _same, "ST_Crosses": lambda p, q, m: np.zeros(len(m), bool),
    "ST_Overlaps": lambda p, q, m: _inner(p, q) & ~_holds(p, q) & ~_holds(q, p) & (not (p[6] or q[6])), "ST_ContainsProperly": lambda p, q, m: (p[0] < q[0]) & (q[2] < p[2]) & (p[1] < q[1]) & (q[3] < p[3]),
}


def box_intersection(a, b):
    p, q = boxes(a), boxes(b)
    if p is None or q is None or p[6] or q[6] or ((p[4] > 0) & (q[4] > 0) & (p[4] != q[4])).any():
        return None
    x0, y0, x1, y1 = np.maximum(p[0], q[0]), np.maximum(p[1], q[1]), np.minimum(p[2], q[2]), np.minimum(p[3], q[3])
    ring = np.stack([x0, y0, x1, y0, x1, y1, x0, y1, x0, y0], axis=1)
    out = _encode(b"GP\x00\x01" + bytes(4) + b"\x01\x03\x00\x00\x00\x01\x00\x00\x00\x05\x00\x00\x00", np.maximum(p[4], q[4]), ring)
    return out, ~(p[5] & q[5] & (x0 < x1) & (y0 < y1))


def _point_in_constant(on_boundary: bool, point_first: bool, name: str):
    """Points against one area, the same value in every row; or rectangles."""
    boxed = _boxed(_BOXED[name])

    def f(a, b):
        p, other = (points(a), b) if point_first else (points(b), a)
        if p is None or other.null_count or not pa.types.is_binary(other.type) or not (np.isfinite(p[0]).all() and np.isfinite(p[1]).all()):
            return boxed(a, b)
        rows = _rows(other, 22)
        if rows is None or (rows != rows[0]).any():
            return boxed(a, b)
        g = M.flat(codec.decode(rows[0].tobytes()))
        if g.kind not in (M.POLYGON, M.MULTIPOLYGON) or M.is_empty(g) or (g.srid > 0 and ((p[2] > 0) & (p[2] != g.srid)).any()):
            return boxed(a, b)
        where = locate(p[0], p[1], P.polygons(g))
        return pa.array(where >= 0 if on_boundary else where > 0)

    return f


#: Whole-batch forms by name.
BATCH = {
    "ST_MakePoint": make_point, "ST_Point": make_point, "ST_MakeEnvelope": make_envelope, "ST_X": _ordinate(0), "ST_Y": _ordinate(1), "ST_SRID": srid, "ST_SetSRID": set_srid, "ST_Transform": transform,
    "ST_NPoints": _constant(point=1, line=lambda n: n, polygon=lambda n: n), "ST_NumPoints": _constant(line=lambda n: n), "ST_GeometryType": _constant(point="ST_Point", line="ST_LineString", polygon="ST_Polygon"), "ST_Dimension": _constant(point=0, line=1, polygon=2),
    "ST_CoordDim": _constant(point=2, line=2, polygon=2), "ST_NDims": _constant(point=2, line=2, polygon=2), "ST_NRings": _constant(point=0, line=0, polygon=1), "ST_NumInteriorRings": _constant(polygon=0), "ST_NumInteriorRing": _constant(polygon=0), "ST_IsEmpty": _constant(point=False, line=False, polygon=False),
    "ST_Area": area, "ST_Area2D": area, "ST_Perimeter": perimeter, "ST_Perimeter2D": perimeter, "ST_Length": length, "ST_Length2D": length, "ST_Distance": distance, "ST_DWithin": dwithin, "ST_Azimuth": azimuth, "ST_DistanceSphere": distance_sphere,
    "ST_StartPoint": _end(0), "ST_EndPoint": _end(-1), "ST_PointN": point_n, "ST_Envelope": envelope, "ST_Centroid": centroid, "ST_MakeLine": make_line, "ST_LineInterpolatePoint": line_interpolate, "ST_LineLocatePoint": line_locate, "ST_Intersection": box_intersection,
    "ST_Reverse": _mapped(lambda x, y: (x[:, ::-1], y[:, ::-1]), 0), "ST_FlipCoordinates": _mapped(lambda x, y: (y, x), 0), "ST_Translate": _mapped(lambda x, y, u, v: (x + u, y + v), 2), "ST_Scale": _mapped(lambda x, y, u, v: (x * u, y * v), 2),
    "ST_TransScale": _mapped(lambda x, y, a, b, u, v: ((x + a) * u, (y + b) * v), 4), "ST_Affine": _mapped(lambda x, y, a, b, d, e, u, v: (a * x + b * y + u, d * x + e * y + v), 6), "ST_Rotate": _mapped(_turn, 1), "ST_RotateZ": _mapped(_turn, 1),
    "ST_AsText": _as_text(False), "ST_AsEWKT": _as_text(True), "ST_GeomFromText": from_text, "ST_GeometryFromText": from_text, "ST_AsBinary": as_wkb, "ST_GeomFromWKB": from_wkb, "ST_GeomFromEWKB": from_wkb,
}
for _axis, _letter in enumerate("XY"):
    for _name, _pick in (("Min", np.min), ("Max", np.max)):
        BATCH[f"ST_{_name}{_letter}"] = BATCH[f"ST_{_letter}{_name}"] = _side(_axis, _pick)
BATCH |= {n: _boxed(t) for n, t in _BOXED.items()}
BATCH |= {n: _point_in_constant(edge, first, n) for n, edge, first in (("ST_Intersects", True, True), ("ST_CoveredBy", True, True), ("ST_Within", False, True), ("ST_Covers", True, False), ("ST_Contains", False, False))}
