"""Interchange formats: GeoJSON, GML, KML, SVG, vector tiles."""

from __future__ import annotations

import json
import math
import re
import struct
import xml.etree.ElementTree as ET

from ..core import codec, crs
from ..core import model as M
from ..core import planar as P
from ..core.codec import fixed
from ..core.model import Geom, GeometryError
from .basic import half_away
from .registry import fn


# -- GeoJSON ---------------------------------------------------------------
def _json_number(v: float, digits: int) -> str:
    f = 10.0**digits
    r = half_away(v * f) / f if math.isfinite(v * f) else v
    return "0" if r == 0 else codec.number(r)


@fn("ST_AsGeoJSON", "g", "g,int", returns="string")
def as_geojson(g, digits=9):
    M.no_z(g, "ST_AsGeoJSON")
    digits = max(0, min(15, digits))

    def pos(c):
        return f"[{_json_number(c[0], digits)},{_json_number(c[1], digits)}]"

    def seq(cs):
        return "[" + ",".join(pos(c) for c in cs) + "]"

    def body(kind, d):
        if d is None or len(d) == 0:
            return "[]"
        if kind == M.POINT:
            return pos(d)
        if kind == M.LINESTRING:
            return seq(d)
        if kind == M.POLYGON:
            return "[" + ",".join(seq(r) for r in d) + "]"
        return "[" + ",".join(body(M.SINGLE[kind], x) for x in d) + "]"

    label = f',"crs":{{"type":"name","properties":{{"name":"EPSG:{g.srid}"}}}}' if g.srid not in (0, 4326) and g.srid > 0 else ""
    if g.kind in M.SURFACES:
        raise GeometryError("surfaces have no GeoJSON form")
    if g.kind == M.COLLECTION:
        return f'{{"type":"GeometryCollection"{label},"geometries":[' + ",".join(as_geojson(c.with_data(c.data, srid=0), digits) for c in g.data) + "]}"
    return f'{{"type":"{g.name}"{label},"coordinates":{body(g.kind, g.data)}}}'


@fn("ST_GeomFromGeoJSON", "text")
def from_geojson(text):
    try:
        v = json.loads(text)
    except ValueError as e:
        raise GeometryError(f"invalid GeoJSON: {e}") from e
    return geojson_value(v)


def geojson_value(v) -> Geom:
    kinds = {n: k for k, n in M.NAMES.items() if k <= M.COLLECTION}
    if not isinstance(v, dict) or v.get("type") not in kinds:
        raise GeometryError("a GeoJSON geometry object is expected")
    kind = kinds[v["type"]]
    if kind == M.COLLECTION:
        return Geom(kind, tuple(geojson_value(x) for x in v.get("geometries", ())), 4326)

    def pos(c):
        if not isinstance(c, list) or len(c) < 2 or not all(isinstance(x, int | float) and not isinstance(x, bool) for x in c):
            raise GeometryError("invalid GeoJSON position")
        if len(c) > 2:
            raise GeometryError("GeoJSON positions with Z are not supported")
        return (float(c[0]), float(c[1]))

    def ring(r):
        out = tuple(pos(c) for c in r)
        if len(out) < 4 or out[0] != out[-1]:
            raise GeometryError("a GeoJSON ring must be closed and have four or more positions")
        return out

    def body(kind, d):
        if not isinstance(d, list):
            raise GeometryError("invalid GeoJSON coordinates")
        if kind == M.POINT:
            return pos(d) if d else None
        if kind == M.LINESTRING:
            return tuple(pos(c) for c in d)
        if kind == M.POLYGON:
            return tuple(ring(r) for r in d)
        return tuple(body(M.SINGLE[kind], x) for x in d)

    return Geom(kind, body(kind, v.get("coordinates")), 4326)


# -- GML -------------------------------------------------------------------
@fn("ST_AsGML", "g", "int,g", "int,g,int", returns="string")
def as_gml(*args):
    version, g, digits = (2, args[0], 15) if len(args) == 1 else (*args, 15)[:3]
    if version not in (2, 3):
        raise GeometryError("GML version 2 or 3 is expected")
    M.no_z(g, "ST_AsGML")
    digits = max(0, min(15, digits))
    srs = ""
    if g.srid > 0:
        srs = f' srsName="EPSG:{g.srid}"' if version == 2 or g.srid else ""
    n = lambda v: fixed(v, digits)

    def seq(cs):
        if version == 2:
            return "<gml:coordinates>" + " ".join(f"{n(c[0])},{n(c[1])}" for c in cs) + "</gml:coordinates>"
        return '<gml:posList srsDimension="2">' + " ".join(f"{n(c[0])} {n(c[1])}" for c in cs) + "</gml:posList>"

    def tag(name, inner, attr=""):
        return f"<gml:{name}{attr}>{inner}</gml:{name}>"

    def ring(r, k):
        name = ("outerBoundaryIs" if k == 0 else "innerBoundaryIs") if version == 2 else ("exterior" if k == 0 else "interior")
        return tag(name, tag("LinearRing", seq(r)))

    def one(kind, d, attr):
        if kind == M.POINT:
            return tag("Point", seq([d]) if version == 2 else f'<gml:pos srsDimension="2">{n(d[0])} {n(d[1])}</gml:pos>', attr)
        if kind == M.LINESTRING:
            if version == 3:
                return tag("Curve", tag("segments", tag("LineStringSegment", seq(d))), attr)
            return tag("LineString", seq(d), attr)
        return tag("Polygon", "".join(ring(r, k) for k, r in enumerate(d)), attr)

    if g.kind == M.COLLECTION:
        inner = "".join(tag("geometryMember", as_gml(version, c.with_data(c.data, srid=0), digits)) for c in g.data)
        return tag("MultiGeometry", inner, srs)
    if g.kind in M.SINGLE:
        names = {
            M.MULTIPOINT: ("MultiPoint", "pointMember"), M.MULTILINESTRING: ("MultiLineString", "lineStringMember") if version == 2 else ("MultiCurve", "curveMember"),
            M.MULTIPOLYGON: ("MultiPolygon", "polygonMember") if version == 2 else ("MultiSurface", "surfaceMember"),
        }[g.kind]
        return tag(names[0], "".join(tag(names[1], one(M.SINGLE[g.kind], d, "")) for d in g.data), srs)
    if M.is_empty(g):
        return f"<gml:{g.name}{srs}/>"
    return one(g.kind, g.data, srs)


@fn("ST_GeomFromGML", "text", "text,int")
def from_gml(text, srid=0):
    try:
        root = ET.fromstring(text if "xmlns:gml" in text or "gml:" not in text else re.sub(r"<([\w:]+)", r'<\1 xmlns:gml="http://www.opengis.net/gml"', text, count=1))
    except ET.ParseError as e:
        raise GeometryError(f"invalid GML: {e}") from e
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    found = re.search(r"(\d+)\D*$", root.get("srsName", ""))
    srid = int(found[1]) if found else srid

    def dims(e, up):
        return int(e.get("srsDimension") or e.get("dimension") or up)

    def floats(t):
        try:
            return [float(v) for v in t.split()]
        except ValueError as e:
            raise GeometryError("invalid number in GML") from e

    def places(e, dim=2):
        out = []
        for c in e:
            kind, d = local(c), dims(c, dim)
            if kind == "coordinates":
                cs, ts = c.get("cs", ","), c.get("ts", " ")
                for t in (c.text or "").replace(ts, " ").split():
                    v = floats(t.replace(cs, " "))
                    out.append((v[0], v[1]))
            elif kind in ("pos", "posList"):
                v = floats(c.text or "")
                if d not in (2, 3) or len(v) % d:
                    raise GeometryError("a GML position list has the wrong length")
                out += [(v[k], v[k + 1]) for k in range(0, len(v), d)]
            elif kind == "coord":
                xy = {local(x): float(x.text) for x in c}
                out.append((xy["X"], xy["Y"]))
            elif kind in ("pointProperty", "pointMember", "Point"):
                out += places(c, d)
            elif kind in ("segments", "LineStringSegment", "LinearRing", "LineString", "curveMember", "Curve"):
                more = places(c, d)
                out += more[1:] if out and more and out[-1] == more[0] else more
        return out

    def parts(e, dim) -> list[Geom]:
        kind, d = local(e), dims(e, dim)
        if kind == "Point":
            c = places(e, d)
            return [Geom(M.POINT, c[0] if c else None)]
        if kind in ("LineString", "Curve", "LinearRing"):
            return [M.line(places(e, d))]
        if kind in ("Polygon", "PolygonPatch", "Triangle", "Rectangle"):
            rings = []
            for c in e:
                if local(c) in ("outerBoundaryIs", "exterior", "innerBoundaryIs", "interior"):
                    r = tuple(places(c, d))
                    if len(r) < 4 or r[0] != r[-1]:
                        raise GeometryError("a GML ring must be closed")
                    rings.insert(0, r) if local(c) in ("outerBoundaryIs", "exterior") else rings.append(r)
            return [M.polygon(rings)]
        return [g for c in e for g in parts(c, d)]

    top, own = local(root), parts(root, dims(root, 2))
    singles = {"Point", "LineString", "Curve", "Polygon", "LinearRing"}
    if top in singles:
        g = own[0]
    else:
        kinds = {g.kind for g in own}
        multi = {"MultiPoint": M.MULTIPOINT, "MultiLineString": M.MULTILINESTRING, "MultiCurve": M.MULTILINESTRING, "MultiPolygon": M.MULTIPOLYGON, "MultiSurface": M.MULTIPOLYGON,
                 "Solid": M.MULTIPOLYGON, "CompositeSurface": M.MULTIPOLYGON, "Surface": M.MULTIPOLYGON, "PolyhedralSurface": M.MULTIPOLYGON, "TriangulatedSurface": M.MULTIPOLYGON, "Tin": M.MULTIPOLYGON}
        if top in multi:
            if kinds - {M.SINGLE[multi[top]]}:
                raise GeometryError(f"unexpected member in GML {top}")
            g = Geom(multi[top], tuple(x.data for x in own))
        elif top == "MultiGeometry":
            g = Geom(M.COLLECTION, tuple(own))
        else:
            raise GeometryError(f"unknown GML element {top}")
    return g.with_data(g.data, srid=srid)


fn("ST_GMLToSQL", "text")(from_gml)


# -- KML -------------------------------------------------------------------
@fn("ST_AsKML", "g", "g,int", "g,int,text", returns="string")
def as_kml(g, digits=15, prefix=""):
    M.no_z(g, "ST_AsKML")
    if g.srid <= 0:
        raise GeometryError("ST_AsKML needs a geometry with a known SRID")
    if prefix and not re.fullmatch(r"[A-Za-z_][\w.-]*", prefix):
        raise GeometryError("the KML prefix is not an XML name")
    p = f"{prefix}:" if prefix else ""
    digits = max(0, min(15, digits))
    f = crs.transformer(g.srid, 4326)
    g = M.map_coords(g, lambda c: f(c[0], c[1]))

    def tag(name, inner):
        return f"<{p}{name}>{inner}</{p}{name}>"

    def seq(cs):
        return tag("coordinates", " ".join(f"{fixed(c[0], digits)},{fixed(c[1], digits)}" for c in cs))

    def one(s: Geom):
        if s.kind == M.POINT:
            return tag("Point", seq([s.data]))
        if s.kind == M.LINESTRING:
            return tag("LineString", seq(s.data))
        return tag("Polygon", "".join(tag("outerBoundaryIs" if k == 0 else "innerBoundaryIs", tag("LinearRing", seq(r))) for k, r in enumerate(s.data)))

    parts = M.members(g)
    if g.kind in M.SINGLE or g.kind == M.COLLECTION:
        return tag("MultiGeometry", "".join(one(s) for s in parts))
    return one(parts[0]) if parts else f"<{p}{g.name}/>"


# -- SVG -------------------------------------------------------------------
@fn("ST_AsSVG", "g", "g,int", "g,int,int", returns="string")
def as_svg(g, rel=0, digits=15):
    M.no_z(g, "ST_AsSVG")
    if rel not in (0, 1):
        raise GeometryError("ST_AsSVG: rel is 0 or 1")
    digits = max(0, min(15, digits))
    n = lambda v: fixed(v, digits)

    def path(cs, ring):
        if ring and rel:
            cs = cs[:-1]
        elif ring:
            cs = cs[:-1]
        out = f"M {n(cs[0][0])} {n(-cs[0][1])}"
        if len(cs) > 1:
            out += " l" if rel else " L"
            x, y = round(cs[0][0], digits), round(cs[0][1], digits)
            for c in cs[1:]:
                if rel:
                    out += f" {n(c[0] - x)} {n(-(c[1] - y))}"
                    x, y = c[0], c[1]
                else:
                    out += f" {n(c[0])} {n(-c[1])}"
        return out + ((" z" if rel else " Z") if ring else "")

    def one(s: Geom):
        if s.kind == M.POINT:
            a, b = ("x", "y") if rel else ("cx", "cy")
            return f'{a}="{n(s.data[0])}" {b}="{n(-s.data[1])}"'
        if s.kind == M.LINESTRING:
            return path(s.data, False)
        return " ".join(path(r, True) for r in s.data)

    sep = "," if g.kind == M.MULTIPOINT else ";" if g.kind == M.COLLECTION else " "
    return sep.join(one(s) for s in M.members(g))


# -- vector tiles ----------------------------------------------------------
@fn("ST_AsMVTGeom", "g,g", "g,g,int", "g,g,int,int", "g,g,int,int,int")
def as_mvt_geom(g, bounds, extent=4096, buf=256, clip=1):
    if any(not math.isfinite(v) for c in M.coords(g) for v in c[:2]):
        raise GeometryError("coordinates must be finite")
    if g.kind == M.COLLECTION or g.kind in M.SURFACES:
        raise GeometryError("ST_AsMVTGeom: collections and surfaces are not supported")
    g = M.flat(g)
    box = M.envelope(bounds)
    if box is None or box[0] == box[2] or box[1] == box[3]:
        raise GeometryError("the tile bounds must have an area")
    if extent <= 0:
        raise GeometryError("the tile extent must be positive")
    if M.is_empty(g):
        return None
    w, h = box[2] - box[0], box[3] - box[1]
    if clip:
        bx, by = buf / extent * w, buf / extent * h
        from .areal import clip_by_box, make_valid

        g = clip_by_box(make_valid(g), M.box_polygon((box[0] - bx, box[1] - by, box[2] + bx, box[3] + by)))
        if M.is_empty(g):
            return None
    to = lambda c: (half_away((c[0] - box[0]) * extent / w) + 0.0, half_away((box[3] - c[1]) * extent / h) + 0.0)
    thin = lambda p: [c for k, c in enumerate(p) if k == 0 or c != p[k - 1]]
    kind = M.dimension(g)
    if kind == 0:
        return M.collect(M.POINT, list(dict.fromkeys(to(c) for c in M.coords(g))), 0)
    if kind == 1:
        lines = [tuple(x) for s in M.members(g) if len(x := thin([to(c) for c in s.data])) > 1]
        return M.collect(M.LINESTRING, lines, 0) if lines else None
    from .areal import even_odd

    rings = [tuple(x) for s in M.members(g) for r in s.data if len(x := thin([to(c) for c in r])) > 3]
    polys = P.arrange([rings], even_odd)
    snapped = [tuple(tuple((half_away(c[0]), half_away(c[1])) for c in r) for r in p) for p in polys]
    # in tile space y points down, so shells run the other way round
    polys = [tuple(M.oriented(r, k != 0) for k, r in enumerate(p)) for p in snapped if abs(M.ring_area(p[0])) > 0]
    return M.collect(M.POLYGON, polys, 0) if polys else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        b = n & 127
        n >>= 7
        out.append(b | (128 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _commands(g: Geom) -> tuple[int, list[int]]:
    """(geometry type, command integers) of a geometry in tile coordinates."""
    x = y = 0
    out: list[int] = []

    def zig(v):
        return (v << 1) ^ (v >> 63)

    def move(cs, command):
        nonlocal x, y
        out.append(command | len(cs) << 3)
        for c in cs:
            px, py = int(half_away(c[0])), int(half_away(c[1]))
            out.extend((zig(px - x), zig(py - y)))
            x, y = px, py

    kind = M.dimension(g)
    if kind == 0:
        pts = list(M.coords(g))
        if pts:
            move(pts, 1)
        return 1, out
    for s in M.members(g):
        for k, p in enumerate([s.data] if s.kind == M.LINESTRING else s.data):
            cs = [c for i, c in enumerate(p) if i == 0 or c != p[i - 1]]
            if s.kind == M.POLYGON:
                if len(cs) < 4 or M.ring_area(cs) == 0:
                    continue
                cs = list(M.oriented(tuple(cs), k == 0))[:-1]
            if len(cs) < 2:
                continue
            move(cs[:1], 1)
            move(cs[1:], 2)
            if s.kind == M.POLYGON:
                out.append(7 | 1 << 3)
    return kind + 1, out


def _tile_value(v) -> bytes:
    if isinstance(v, bool):
        return _varint(7 << 3) + _varint(int(v))
    if isinstance(v, int):
        return _varint(4 << 3) + _varint(v) if v >= 0 else _varint(6 << 3) + _varint((v << 1 ^ v >> 63) & (1 << 64) - 1)
    if isinstance(v, float):
        return _varint(3 << 3 | 1) + struct.pack("<d", v)
    return _field(1, v.encode())


def encode_tile(features: list[tuple[Geom, dict]], name: str = "default", extent: int = 4096) -> bytes:
    """One layer of a vector tile; nulls are left out, nested values are an error."""
    keys: dict = {}
    values: dict = {}
    body = b""
    for g, props in features:
        kind, commands = _commands(g)
        if not commands:
            continue
        tags = []
        for k, v in props.items():
            if v is None:
                continue
            if isinstance(v, dict | list):
                raise GeometryError(f"property {k!r} is nested")
            tags += [keys.setdefault(k, len(keys)), values.setdefault((type(v).__name__, v), len(values))]
        f = (_field(2, b"".join(map(_varint, tags))) if tags else b"") + _varint(3 << 3) + _varint(kind) + _field(4, b"".join(map(_varint, commands)))
        body += _field(2, f)
    layer = _field(1, name.encode()) + body + b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _tile_value(v)) for _, v in values)
    layer += _varint(5 << 3) + _varint(extent) + _varint(15 << 3) + _varint(2)
    return _field(3, layer)
