"""The geometry value: type code, nested coordinate tuples, SRID and dimension flags."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

POINT, LINESTRING, POLYGON, MULTIPOINT, MULTILINESTRING, MULTIPOLYGON, COLLECTION = range(1, 8)
SURFACE, TIN, TRIANGLE = 15, 16, 17
#: Type codes and names of the simple-feature types (fixed values).
NAMES = {
    POINT: "Point", LINESTRING: "LineString", POLYGON: "Polygon", MULTIPOINT: "MultiPoint", MULTILINESTRING: "MultiLineString",
    MULTIPOLYGON: "MultiPolygon", COLLECTION: "GeometryCollection", SURFACE: "PolyhedralSurface", TIN: "Tin", TRIANGLE: "Triangle",
}
SINGLE = {MULTIPOINT: POINT, MULTILINESTRING: LINESTRING, MULTIPOLYGON: POLYGON}
MULTI = {v: k for k, v in SINGLE.items()}
SURFACES = (SURFACE, TIN, TRIANGLE)


class GeometryError(ValueError):
    """Malformed input, or an operation that is not defined for it."""


@dataclass(frozen=True)
class Geom:
    """``data``: a point is a coordinate tuple or None, a line a tuple of those, a polygon a tuple of
    rings, a multi type a tuple of its members' data, a collection a tuple of Geom; a surface is a
    tuple of polygons."""

    kind: int
    data: object
    srid: int = 0
    z: bool = False
    m: bool = False
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    def with_data(self, data, kind: int | None = None, **changes) -> Geom:
        return replace(self, kind=self.kind if kind is None else kind, data=data, _cache={}, **changes)

    @property
    def name(self) -> str:
        return NAMES[self.kind]


def point(x: float, y: float, srid: int = 0) -> Geom:
    return Geom(POINT, (x, y), srid)


def line(coords, srid: int = 0, **dims) -> Geom:
    return Geom(LINESTRING, tuple(coords), srid, **dims)


def polygon(rings, srid: int = 0, **dims) -> Geom:
    return Geom(POLYGON, tuple(tuple(r) for r in rings), srid, **dims)


def members(g: Geom) -> list[Geom]:
    """The single geometries of a value, collections flattened, empty ones left out."""
    if g.kind == COLLECTION:
        return [x for c in g.data for x in members(c)]
    if g.kind in SINGLE:
        return [Geom(SINGLE[g.kind], d, g.srid, g.z, g.m) for d in g.data if d]
    if g.kind in (SURFACE, TIN):
        return [Geom(POLYGON, d, g.srid, g.z, g.m) for d in g.data if d]
    if g.kind == TRIANGLE:
        return [Geom(POLYGON, d, g.srid, g.z, g.m) for d in g.data[:1] if d]
    return [g] if g.data and (g.kind != POLYGON or g.data[0]) else []


def is_empty(g: Geom) -> bool:
    return not members(g)


def dimension(g: Geom) -> int:
    """0, 1 or 2 by type; a collection has that of its largest member."""
    if g.kind == COLLECTION:
        return max((dimension(c) for c in g.data), default=0)
    return {POINT: 0, MULTIPOINT: 0, LINESTRING: 1, MULTILINESTRING: 1}.get(g.kind, 2)


def coords(g: Geom):
    """All vertices in order, closing ones included."""
    for s in members(g):
        if s.kind == POINT:
            yield s.data
        elif s.kind == LINESTRING:
            yield from s.data
        else:
            for ring in s.data:
                yield from ring


def paths(g: Geom) -> list[tuple]:
    """Lines and rings as coordinate sequences."""
    out = []
    for s in members(g):
        if s.kind == LINESTRING:
            out.append(s.data)
        elif s.kind == POLYGON:
            out += [r for r in s.data if r]
    return out


def map_coords(g: Geom, f, **changes) -> Geom:
    """The same structure with every coordinate replaced."""

    def go(kind, d):
        if d is None or d == ():
            return d
        if kind == POINT:
            return f(d)
        if kind == LINESTRING:
            return tuple(f(c) for c in d)
        if kind == POLYGON:
            return tuple(tuple(f(c) for c in r) for r in d)
        if kind == COLLECTION:
            return tuple(map_coords(c, f, **changes) for c in d)
        if kind in SURFACES:
            return tuple(go(POLYGON, p) for p in d)
        return tuple(go(SINGLE[kind], x) for x in d)

    return g.with_data(go(g.kind, g.data), **changes)


def map_paths(g: Geom, f) -> Geom:
    """The same structure with every line and ring (as a sequence) replaced; ``f(seq, is_ring)``."""

    def go(kind, d):
        if kind == LINESTRING:
            return tuple(f(d, False)) if d else d
        if kind == POLYGON:
            return tuple(tuple(f(r, True)) for r in d)
        if kind == COLLECTION:
            return tuple(map_paths(c, f) for c in d)
        if kind in SURFACES:
            return tuple(go(POLYGON, p) for p in d)
        if kind in (MULTILINESTRING, MULTIPOLYGON):
            return tuple(go(SINGLE[kind], x) for x in d)
        return d

    return g.with_data(go(g.kind, g.data))


def envelope(g: Geom) -> tuple[float, float, float, float] | None:
    """minx, miny, maxx, maxy, or None if there is no coordinate."""
    if "box" not in g._cache:
        xs, ys = [], []
        for c in coords(g):
            xs.append(c[0])
            ys.append(c[1])
        g._cache["box"] = (min(xs), min(ys), max(xs), max(ys)) if xs else None
    return g._cache["box"]


def box_polygon(box, srid: int = 0) -> Geom:
    a, b, c, d = box
    return polygon([((a, b), (a, d), (c, d), (c, b), (a, b))], srid)


def collect(kind: int, parts: list, srid: int = 0, **dims) -> Geom:
    """No part: the typed empty; one: the single type; more: the multi type."""
    if len(parts) == 1:
        return Geom(kind, parts[0], srid, **dims)
    if not parts:
        return Geom(kind, None if kind == POINT else (), srid, **dims)
    return Geom(MULTI[kind], tuple(parts), srid, **dims)


def ring_area(ring) -> float:
    """Signed area: positive for counter-clockwise rings."""
    if len(ring) < 3:
        return 0.0
    x0, y0 = ring[0][0], ring[0][1]
    s = 0.0
    for a, b in zip(ring, ring[1:]):
        s += (a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0)
    return s / 2


def oriented(ring, ccw: bool):
    return ring if (ring_area(ring) >= 0) == ccw else tuple(reversed(ring))


def path_length(path) -> float:
    return sum(math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(path, path[1:]))


def check_srid(a: Geom, b: Geom) -> None:
    if a.srid > 0 and b.srid > 0 and a.srid != b.srid:
        raise GeometryError(f"operands have different SRIDs: {a.srid} and {b.srid}")


def no_z(g: Geom, what: str) -> Geom:
    if g.z or g.m:
        raise GeometryError(f"{what}: coordinates with Z or M are not supported here; use ST_Force2D first")
    return g


def flat(g: Geom) -> Geom:
    """The value without Z and M."""
    if not (g.z or g.m):
        return g
    return map_coords(g, lambda c: (c[0], c[1]), z=False, m=False)
