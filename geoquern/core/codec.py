"""Encodings: GeoPackage binary, ISO and extended WKB, WKT."""

from __future__ import annotations

import math
import re
import struct
from functools import lru_cache

import numpy as np

from . import model as M
from .model import Geom, GeometryError

MAX_DEPTH = 32
#: Sizes in doubles of the envelope kinds of a GeoPackage header (fixed values of the format).
ENVELOPES = {0: 0, 1: 4, 2: 6, 3: 6, 4: 8}


def _gpb_header(b: bytes) -> tuple[int, int, int]:
    """(flags, srid, offset of the WKB)."""
    if len(b) < 8:
        raise GeometryError("truncated GeoPackage header")
    if b[2] != 0:
        raise GeometryError("unsupported GeoPackage version")
    flags = b[3]
    kind = (flags >> 1) & 7
    if kind not in ENVELOPES or flags & 0xC0:
        raise GeometryError("invalid GeoPackage flags")
    if flags & 0x20:
        raise GeometryError("extended GeoPackage geometries are not supported")
    at = 8 + 8 * ENVELOPES[kind]
    if len(b) < at:
        raise GeometryError("truncated GeoPackage envelope")
    return flags, struct.unpack_from("<i" if flags & 1 else ">i", b, 4)[0], at


def is_gpb(b: bytes) -> bool:
    return b[:2] == b"GP"


class _Reader:
    def __init__(self, b: bytes, at: int):
        self.b, self.at = b, at

    def geometry(self, depth: int = 0, outer: Geom | None = None) -> Geom:
        if depth > MAX_DEPTH:
            raise GeometryError("geometry is nested too deeply")
        b = self.b
        if self.at + 5 > len(b):
            raise GeometryError("truncated WKB")
        order = b[self.at]
        if order not in (0, 1):
            raise GeometryError("invalid WKB byte order")
        e = "<" if order else ">"
        word = struct.unpack_from(e + "I", b, self.at + 1)[0]
        self.at += 5
        base, iso = (word & 0xFFFF) % 1000, (word & 0xFFFF) // 1000
        z = bool(word & 0x80000000) or iso in (1, 3)
        m = bool(word & 0x40000000) or iso in (2, 3)
        srid = 0
        if word & 0x20000000:
            srid = self._number(e + "i", 4)
        if base not in M.NAMES or iso > 3:
            raise GeometryError(f"unsupported WKB type {word}")
        dims = 2 + z + m
        if base == M.POINT:
            (c,) = self._coords(e, dims, 1)
            data = None if math.isnan(c[0]) and math.isnan(c[1]) else c
        elif base == M.LINESTRING:
            data = tuple(self._coords(e, dims, self._count(e, 8 * dims)))
        elif base in (M.POLYGON, M.TRIANGLE):
            rings = tuple(tuple(self._coords(e, dims, self._count(e, 8 * dims))) for _ in range(self._count(e, 4)))
            data = (rings,) if base == M.TRIANGLE and rings else rings
        else:
            parts = [self.geometry(depth + 1) for _ in range(self._count(e, 5))]
            if base == M.COLLECTION:
                data = tuple(parts)
            else:
                want = {M.SURFACE: (M.POLYGON,), M.TIN: (M.TRIANGLE, M.POLYGON)}.get(base) or (M.SINGLE[base],)
                if any(p.kind not in want for p in parts):
                    raise GeometryError("a member of a multi geometry has the wrong type")
                data = tuple((p.data[0] if p.data else ()) if p.kind == M.TRIANGLE else p.data for p in parts)
        return Geom(base, data, srid, z, m)

    def _number(self, fmt: str, size: int):
        if self.at + size > len(self.b):
            raise GeometryError("truncated WKB")
        v = struct.unpack_from(fmt, self.b, self.at)[0]
        self.at += size
        return v

    def _count(self, e: str, least: int) -> int:
        n = self._number(e + "I", 4)
        if n * least > len(self.b) - self.at:
            raise GeometryError("a WKB count exceeds the data")
        return n

    def _coords(self, e: str, dims: int, n: int):
        size = 8 * dims * n
        if self.at + size > len(self.b):
            raise GeometryError("truncated WKB")
        v = struct.unpack_from(f"{e}{dims * n}d", self.b, self.at)
        self.at += size
        return list(zip(*[iter(v)] * dims, strict=True)) if n else []


#: Small values are kept for as many rows as an Arrow batch holds, large ones only if they are few (constants).
SMALL = 1024


def _decode(b: bytes) -> Geom:
    srid, at = None, 0
    if is_gpb(b):
        _, srid, at = _gpb_header(b)
    r = _Reader(b, at)
    g = r.geometry()
    return g if srid is None else g.with_data(g.data, srid=srid)


_decode_large = lru_cache(maxsize=32)(_decode)
_seen: dict[bytes, Geom] = {}
SEEN = 1 << 14


def _remember(b: bytes, g: Geom) -> Geom:
    if len(_seen) >= SEEN:
        _seen.clear()
    _seen[b] = g
    return g


def decode(b: bytes) -> Geom:
    """A geometry from GeoPackage binary, WKB or EWKB, told apart by content."""
    if isinstance(b, str):
        raise GeometryError("got text where a geometry is expected; did you mean ST_GeomFromText?")
    b = bytes(b)
    if not b:
        raise GeometryError("empty geometry bytes")
    if len(b) > SMALL:
        return _decode_large(b)
    g = _seen.get(b)
    return _remember(b, _decode(b)) if g is None else g


def wkb(g: Geom, srid_flag: bool = False) -> bytes:
    """Little-endian ISO WKB, or EWKB with the SRID if it is asked for and known."""

    def head(kind):
        return struct.pack("<BI", 1, kind + 1000 * (g.z + 2 * g.m))

    def seq(cs):
        return struct.pack(f"<I{sum(map(len, cs))}d", len(cs), *(v for c in cs for v in c))

    def go(kind, d, dims):
        if kind == M.POINT:
            c = d if d is not None else (math.nan,) * dims
            return head(kind) + struct.pack(f"<{dims}d", *c)
        if kind == M.LINESTRING:
            return head(kind) + seq(d)
        if kind == M.POLYGON:
            return head(kind) + struct.pack("<I", len(d)) + b"".join(seq(r) for r in d)
        if kind == M.TRIANGLE:
            rings = d[0] if d else ()
            return head(kind) + struct.pack("<I", len(rings)) + b"".join(seq(r) for r in rings)
        if kind == M.COLLECTION:
            return head(kind) + struct.pack("<I", len(d)) + b"".join(wkb(x) for x in d)
        one = M.SINGLE.get(kind, M.POLYGON)
        if kind == M.TIN:
            return head(kind) + struct.pack("<I", len(d)) + b"".join(go(M.TRIANGLE, (x,), dims) for x in d)
        return head(kind) + struct.pack("<I", len(d)) + b"".join(go(one, x, dims) for x in d)

    out = go(g.kind, g.data, 2 + g.z + g.m)
    if srid_flag and g.srid > 0:
        word = struct.unpack_from("<I", out, 1)[0]
        base, iso = word % 1000, word // 1000
        word = base | 0x20000000 | (0x80000000 if iso in (1, 3) else 0) | (0x40000000 if iso in (2, 3) else 0)
        return b"\x01" + struct.pack("<Ii", word, g.srid) + out[5:]
    return out


def encode(g: Geom) -> bytes:
    """The canonical value: GeoPackage binary without envelope.

    Small values are remembered, so a function around this one need not decode them again."""
    b = b"GP\x00" + bytes([1 | (0x10 if M.is_empty(g) else 0)]) + struct.pack("<i", g.srid) + wkb(g)
    if g.kind <= M.MULTIPOLYGON and len(b) <= SMALL and b not in _seen:
        _remember(b, g)
    return b


def payload(b: bytes) -> tuple[int, bytes]:
    """(srid, WKB bytes as they stand)."""
    if is_gpb(b):
        _, srid, at = _gpb_header(b)
        return srid, b[at:]
    return decode(b).srid, wkb(decode(b))


def storage(b: bytes) -> bytes:
    """GeoPackage binary for storage: with an XY envelope unless it is a point or empty."""
    g = decode(b)
    srid, body = payload(b)
    box = M.envelope(g)
    flags = 1 | (0x10 if box is None else 0)
    env = b""
    if box is not None and g.kind != M.POINT:
        flags |= 2
        env = struct.pack("<4d", box[0], box[2], box[1], box[3])
    return b"GP\x00" + bytes([flags]) + struct.pack("<i", srid) + env + body


def header_box(b: bytes) -> tuple[float, float, float, float] | None:
    """The envelope of a storage header, without reading coordinates."""
    if not is_gpb(b):
        return None
    flags, _, at = _gpb_header(b)
    if at == 8:
        return None
    x0, x1, y0, y1 = struct.unpack_from(("<" if flags & 1 else ">") + "4d", b, 8)
    return (x0, y0, x1, y1)


def number(v: float) -> str:
    """Shortest text that reads back as the same double, without an exponent."""
    if v != v:
        return "NaN"
    if math.isinf(v):
        return "inf" if v > 0 else "-inf"
    if v == int(v) and abs(v) < 1e15:
        return ("-0" if v == 0 and math.copysign(1, v) < 0 else str(int(v)))
    text = repr(v)  # the shortest digits as well, in positional form but for very large or small values
    return text.removesuffix(".0") if "e" not in text else np.format_float_positional(v, trim="-", unique=True)


def fixed(v: float, digits: int) -> str:
    """At most ``digits`` decimals, trailing zeros and a minus before zero cut."""
    s = f"{v:.{digits}f}"
    if "." in s:
        s = s.rstrip("0").rstrip(".")
    return "0" if s in ("-0", "") else s


def wkt(g: Geom) -> str:
    M.no_z(g, "WKT")

    def c(p):
        return f"{number(p[0])} {number(p[1])}"

    def seq(ps):
        return "(" + ",".join(c(p) for p in ps) + ")"

    def body(kind, d):
        if d is None or len(d) == 0 or (kind == M.POLYGON and not d[0]):
            return " EMPTY"
        if kind == M.POINT:
            return f"({c(d)})"
        if kind == M.LINESTRING:
            return seq(d)
        if kind == M.POLYGON:
            return "(" + ",".join(seq(r) for r in d) + ")"
        if kind == M.COLLECTION:
            return "(" + ",".join(wkt(x) for x in d) + ")"
        one = M.SINGLE.get(kind, M.POLYGON)
        return "(" + ",".join(body(one, x).strip() for x in d) + ")"

    if g.kind in M.SURFACES:
        raise GeometryError("surfaces have no two-dimensional WKT; use ST_Force2D first")
    return g.name.upper() + body(g.kind, g.data)


_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")
_WKT_KINDS = {n.upper(): k for k, n in M.NAMES.items()}


def parse_wkt(text: str, srid: int = 0) -> Geom:
    """WKT in two dimensions; Z, M and a bare POINT EMPTY are refused."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise GeometryError(f"invalid WKT near {text[at : at + 20]!r}")
        tokens.append(m[1])
        at = m.end()
    pos = 0

    def peek():
        return tokens[pos] if pos < len(tokens) else ""

    def take(want=None):
        nonlocal pos
        t = peek()
        if not t or (want and t != want):
            raise GeometryError(f"invalid WKT: expected {want or 'more'}, got {t or 'the end'}")
        pos += 1
        return t

    def coord():
        v = []
        while peek() and peek() not in "(),":
            try:
                v.append(float(take()))
            except ValueError as e:
                raise GeometryError("invalid WKT number") from e
        if len(v) > 2:
            raise GeometryError("WKT with Z or M is not supported")
        if len(v) != 2:
            raise GeometryError("invalid WKT coordinate")
        return tuple(v)

    def listed(item):
        if peek().upper() == "EMPTY":
            take()
            return ()
        take("(")
        out = [item()]
        while peek() == ",":
            take()
            out.append(item())
        take(")")
        return tuple(out)

    def ring():
        r = listed(coord)
        if r and (len(r) < 4 or r[0] != r[-1]):
            raise GeometryError("a polygon ring must be closed and have four or more points")
        return r

    def path():
        r = listed(coord)
        if len(r) == 1:
            raise GeometryError("a line needs two points")
        return r

    def lone():
        if peek() == "(":
            take()
            c = coord()
            take(")")
            return c
        if peek().upper() == "EMPTY":
            take()
            return None
        return coord()

    def geometry(top=False):
        name = take().upper()
        kind = _WKT_KINDS.get(name)
        if kind is None or kind in M.SURFACES:
            raise GeometryError(f"unknown WKT type {name}")
        if peek().upper() in ("Z", "M", "ZM"):
            raise GeometryError("WKT with Z or M is not supported")
        if kind == M.POINT:
            if peek().upper() == "EMPTY":
                if top:
                    raise GeometryError("POINT EMPTY is not supported")
                take()
                return Geom(kind, None, srid)
            take("(")
            c = coord()
            take(")")
            return Geom(kind, c, srid)
        item = {
            M.LINESTRING: None, M.POLYGON: ring, M.MULTIPOINT: lone, M.MULTILINESTRING: path,
            M.MULTIPOLYGON: lambda: listed(ring), M.COLLECTION: geometry,
        }[kind]
        return Geom(kind, path() if kind == M.LINESTRING else listed(item), srid)

    g = geometry(True)
    if pos != len(tokens):
        raise GeometryError("text after the WKT geometry")
    return g


def parse_ewkt(text: str) -> Geom:
    m = re.match(r"\s*SRID\s*=\s*(-?\d+)\s*;", text, re.IGNORECASE)
    return parse_wkt(text[m.end() :], int(m[1])) if m else parse_wkt(text)
