"""Codecs, constructors, SRID and dimension control, GeoPackage accessors."""

from __future__ import annotations

import re
import struct

from ..core import codec, crs
from ..core import model as M
from ..core.model import Geom, GeometryError
from .registry import FUNCTIONS, alias, fn


def _relabel(g: Geom, srid: int | None) -> Geom:
    return g if srid is None else g.with_data(g.data, srid=srid)


@fn("ST_GeomFromText ST_GeometryFromText", "text", "text,int")
def geom_from_text(t, srid=0):
    return codec.parse_wkt(t, srid)


@fn("ST_GeomFromWKB ST_GeomFromEWKB", "g", "g,int")
def geom_from_wkb(g, srid=None):
    return _relabel(M.no_z(g, "ST_GeomFromWKB"), srid)


@fn("ST_GeomFromGPB", "blob")
def geom_from_gpb(b):
    if not codec.is_gpb(b):
        raise GeometryError("not a GeoPackage geometry")
    g = codec.decode(b)
    return b"GP\x00" + bytes([1 | (0x10 if M.is_empty(g) else 0)]) + struct.pack("<i", g.srid) + codec.payload(b)[1]


@fn("ST_AsText", "g", returns="string")
def as_text(g):
    return codec.wkt(g)


@fn("ST_AsBinary", "g")
def as_binary(g):
    return codec.wkb(M.no_z(g, "ST_AsBinary"))


@fn("ST_AsGPB", "blob")
def as_gpb(b):
    return codec.storage(b)


@fn("ST_AsEWKT", "g", returns="string")
def as_ewkt(g):
    return (f"SRID={g.srid};" if g.srid > 0 else "") + codec.wkt(g)


@fn("ST_GeomFromEWKT", "text")
def geom_from_ewkt(t):
    return codec.parse_ewkt(t)


@fn("ST_AsEWKB", "g")
def as_ewkb(g):
    return codec.wkb(g, srid_flag=True)


@fn("ST_AsHexEWKB", "g", returns="string")
def as_hex_ewkb(g):
    return codec.wkb(g, srid_flag=True).hex().upper()


def _typed(kind):
    def from_text(t, srid=0):
        g = codec.parse_wkt(t, srid)
        return g if g.kind == kind else None

    def from_wkb(g, srid=None):
        return _relabel(M.no_z(g, "WKB"), srid) if g.kind == kind else None

    return from_text, from_wkb


#: Names of typed readers by type: text readers with one or two arguments, with one, WKB readers with one or two, with one.
_TYPED = {
    M.POINT: ("ST_PointFromText", "", "ST_PointFromWKB", ""),
    M.LINESTRING: ("ST_LineFromText ST_LineStringFromText", "", "ST_LineFromWKB ST_LineStringFromWKB", ""),
    M.POLYGON: ("ST_PolyFromText ST_PolygonFromText", "", "ST_PolyFromWKB ST_PolygonFromWKB", ""),
    M.MULTIPOINT: ("ST_MPointFromText", "ST_MultiPointFromText", "ST_MPointFromWKB ST_MultiPointFromWKB", ""),
    M.MULTILINESTRING: ("ST_MLineFromText", "ST_MultiLineStringFromText", "ST_MLineFromWKB ST_MultiLineFromWKB", ""),
    M.MULTIPOLYGON: ("ST_MPolyFromText", "ST_MultiPolygonFromText", "ST_MPolyFromWKB ST_MultiPolyFromWKB", ""),
}
for _kind, (_a, _b, _c, _d) in _TYPED.items():
    _text, _bytes = _typed(_kind)
    fn(_a, "text", "text,int")(_text)
    if _b:
        fn(_b, "text")(_text)
    fn(_c, "g", "g,int")(_bytes)


@fn("ST_SRID", "g", returns="int")
def srid(g):
    return g.srid


@fn("ST_SetSRID", "blob,int")
def set_srid(b, n):
    g = codec.decode(b)
    if codec.is_gpb(b):
        return b[:4] + struct.pack("<i" if b[3] & 1 else ">i", n) + b[8:]
    return codec.encode(g.with_data(g.data, srid=n))


@fn("ST_Transform", "g,int")
def transform(g, to):
    if g.srid <= 0:
        raise GeometryError("ST_Transform needs a geometry with a known SRID")
    f = crs.transformer(g.srid, to)
    return M.map_coords(g, lambda c: (*f(c[0], c[1]), *c[2:]), srid=to)


# -- constructors ----------------------------------------------------------
@fn("ST_MakePoint", "dbl,dbl", "dbl,dbl,dbl")
def make_point(x, y, z=None):
    return M.point(x, y) if z is None else Geom(M.POINT, (x, y, z), 0, True)


@fn("ST_Point", "dbl,dbl", "dbl,dbl,int")
def st_point(x, y, srid=0):
    return M.point(x, y, srid)


@fn("ST_MakeEnvelope", "dbl,dbl,dbl,dbl", "dbl,dbl,dbl,dbl,int")
def make_envelope(a, b, c, d, srid=0):
    return M.box_polygon((a, b, c, d), srid)


@fn("ST_MakeLine", "g,g")
def make_line(a, b):
    M.check_srid(a, b)
    pts = []
    for g in (a, b):
        if g.kind not in (M.POINT, M.MULTIPOINT, M.LINESTRING):
            raise GeometryError("ST_MakeLine takes points and lines")
        own = list(M.coords(g))
        if pts and own and a.kind == b.kind == M.LINESTRING and pts[-1] == own[0]:
            own = own[1:]
        pts += own
    if a.z != b.z or a.m != b.m:
        raise GeometryError("ST_MakeLine: operands have different dimensions")
    if len(pts) < 2:
        raise GeometryError("ST_MakeLine needs two points")
    return Geom(M.LINESTRING, tuple(pts), a.srid if a.srid > 0 else b.srid, a.z, a.m)


@fn("ST_MakePolygon", "g")
def make_polygon(g):
    if g.kind != M.LINESTRING or len(g.data) < 4 or g.data[0] != g.data[-1]:
        raise GeometryError("ST_MakePolygon needs a closed line of four or more points")
    return Geom(M.POLYGON, (g.data,), g.srid, g.z, g.m)


@fn("ST_Polygon", "g,int")
def st_polygon(g, srid):
    return _relabel(make_polygon(g), srid)


@fn("ST_LineFromMultiPoint", "g")
def line_from_multipoint(g):
    if g.kind != M.MULTIPOINT or len(g.data) < 2:
        return None
    return g.with_data(g.data, M.LINESTRING)


@fn("ST_MakeBox2D", "g,g")
def make_box_2d(a, b):
    M.check_srid(a, b)
    if a.kind != M.POINT or b.kind != M.POINT or not a.data or not b.data:
        raise GeometryError("ST_MakeBox2D takes two points")
    (x0, y0), (x1, y1) = a.data[:2], b.data[:2]
    return M.box_polygon((min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)), a.srid if a.srid > 0 else b.srid)


@fn("ST_Multi", "g")
def multi(g):
    if g.kind in M.MULTI:
        return g.with_data((g.data,) if g.data else (), M.MULTI[g.kind])
    return g


# -- dimensions ------------------------------------------------------------
@fn("ST_Force2D", "g")
def force_2d(g):
    if g.kind in M.SURFACES:
        g = M.flat(g)
        return g.with_data(tuple(g.data), M.MULTIPOLYGON)
    return M.flat(g)


@fn("ST_Force3D ST_Force3DZ", "g", "g,dbl")
def force_3d(g, z=0.0):
    if g.z:
        return M.map_coords(g, lambda c: c[:3], m=False) if g.m else g
    return M.map_coords(g, lambda c: (c[0], c[1], z), z=True, m=False)


@fn("ST_HasZ", "g", returns="boolean")
def has_z(g):
    return g.z


@fn("ST_HasM", "g", returns="boolean")
def has_m(g):
    return g.m


@fn("ST_Z", "g", returns="double")
def st_z(g):
    return g.data[2] if g.kind == M.POINT and g.data and g.z else None


@fn("ST_M", "g", returns="double")
def st_m(g):
    return g.data[-1] if g.kind == M.POINT and g.data and g.m else None


@fn("ST_CoordDim ST_NDims", "g", returns="int")
def coord_dim(g):
    return 2 + g.z + g.m


# -- boxes -----------------------------------------------------------------
_BOX = re.compile(r"\s*BOX(3D)?\s*\(\s*([^,()]+?)\s*,\s*([^,()]+?)\s*\)\s*$", re.IGNORECASE)


def parse_box(text: str) -> tuple[float, ...]:
    """minx, miny, minz, maxx, maxy, maxz of BOX or BOX3D text; a missing z is 0."""
    m = _BOX.match(text)
    if not m:
        raise GeometryError(f"invalid box text {text[:40]!r}")
    try:
        a, b = ([float(v) for v in part.split()] for part in m.group(2, 3))
    except ValueError as e:
        raise GeometryError("invalid number in box text") from e
    if len(a) != len(b) or len(a) not in (2, 3):
        raise GeometryError("box corners need two or three numbers each")
    a, b = a + [0.0] * (3 - len(a)), b + [0.0] * (3 - len(b))
    return (*map(min, a, b), *map(max, a, b))


def _side(k: int):
    def f(b):
        if isinstance(b, str):
            return parse_box(b)[(0, 1, 3, 4)[k]]
        box = codec.header_box(bytes(b)) or M.envelope(codec.decode(bytes(b)))
        return None if box is None else box[k]

    return f


from .registry import CONVERT  # noqa: E402

CONVERT["gbox"] = lambda v: v
for _k, _names in enumerate(("ST_MinX ST_XMin", "ST_MinY ST_YMin", "ST_MaxX ST_XMax", "ST_MaxY ST_YMax")):
    fn(_names, "gbox", returns="double")(_side(_k))


def _height(pick, at):
    def f(g):
        if isinstance(g, str):
            return parse_box(g)[at]
        if M.is_empty(g):
            return None
        return pick(c[2] for c in M.coords(g)) if g.z else 0.0

    return f


fn("ST_ZMin", "gtext", returns="double")(_height(min, 2))
fn("ST_ZMax", "gtext", returns="double")(_height(max, 5))


@fn("ST_IsEmpty", "blob", returns="boolean")
def st_is_empty(b):
    return M.is_empty(codec.decode(b))


#: Parents in the OGC type hierarchy (fixed values).
_PARENTS = {
    "POINT": "GEOMETRY", "CURVE": "GEOMETRY", "SURFACE": "GEOMETRY", "GEOMCOLLECTION": "GEOMETRY", "LINESTRING": "CURVE", "CIRCULARSTRING": "CURVE",
    "COMPOUNDCURVE": "CURVE", "CURVEPOLYGON": "SURFACE", "POLYGON": "CURVEPOLYGON", "POLYHEDRALSURFACE": "SURFACE", "TIN": "POLYHEDRALSURFACE", "TRIANGLE": "POLYGON",
    "MULTIPOINT": "GEOMCOLLECTION", "MULTICURVE": "GEOMCOLLECTION", "MULTISURFACE": "GEOMCOLLECTION", "MULTILINESTRING": "MULTICURVE", "MULTIPOLYGON": "MULTISURFACE",
}


@fn("GPKG_IsAssignable", "text,text", returns="boolean")
def is_assignable(expected, actual):
    def clean(t):
        t = t.upper().removeprefix("ST_")
        return "GEOMCOLLECTION" if t == "GEOMETRYCOLLECTION" else t

    want, at = clean(expected), clean(actual)
    while at:
        if at == want:
            return True
        at = _PARENTS.get(at, "")
    return False


@fn("gpkg_extension_required", "g", returns="string")
def extension_required(g):
    return f"gpkg_geom_{g.name.upper()}" if g.kind in M.SURFACES else None


@fn("ST_Summary", "g", returns="string")
def summary(g):
    n = sum(1 for _ in M.coords(g))
    flags = ("Z" if g.z else "") + ("M" if g.m else "") + ("S" if g.srid > 0 else "")
    return f"{g.name}{f'[{flags}]' if flags else ''} with {n} vertices"


@fn("ST_MemSize", "blob", returns="int")
def mem_size(b):
    return len(codec.storage(b))


__all__ = ["FUNCTIONS", "alias"]
