"""Grids, geohashes and cell numbers."""

from __future__ import annotations

import math

from ..core import h3
from ..core import model as M
from ..core.model import Geom, GeometryError
from .registry import fn

MOST_CELLS = 100_000
#: The geohash alphabet (fixed value).
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def _cells(n):
    if n > MOST_CELLS:
        raise GeometryError(f"the grid would have more than {MOST_CELLS} cells")


@fn("ST_SquareGrid", "dbl,g")
def square_grid(size, bounds):
    box = M.envelope(bounds)
    if box is None or not size > 0 or not math.isfinite(size):
        return Geom(M.MULTIPOLYGON, (), bounds.srid)
    i0, i1, j0, j1 = (math.floor(v / size) for v in (box[0], box[2], box[1], box[3]))
    _cells((i1 - i0 + 1) * (j1 - j0 + 1))
    out = []
    for i in range(i0, i1 + 1):
        for j in range(j0, j1 + 1):
            a, b, c, d = i * size, j * size, (i + 1) * size, (j + 1) * size
            if a <= box[2] and c > box[0] and b <= box[3] and d > box[1]:
                out.append((((a, b), (a, d), (c, d), (c, b), (a, b)),))
    return Geom(M.MULTIPOLYGON, tuple(out), bounds.srid)


@fn("ST_HexagonGrid", "dbl,g")
def hexagon_grid(size, bounds):
    box = M.envelope(bounds)
    if box is None or not size > 0 or not math.isfinite(size):
        return Geom(M.MULTIPOLYGON, (), bounds.srid)
    half, step = size * math.sqrt(3) / 2, 1.5 * size
    i0, i1 = math.floor((box[0] - size) / step), math.ceil((box[2] + size) / step)
    j0, j1 = math.floor((box[1] - 2 * half) / (2 * half)), math.ceil((box[3] + half) / (2 * half))
    _cells((i1 - i0 + 1) * (j1 - j0 + 1) // 4)
    out = []
    for i in range(i0, i1 + 1):
        for j in range(j0, j1 + 1):
            x, y = i * step, j * 2 * half + (half if i % 2 == 1 else 0.0)
            if x - size <= box[2] and x + size > box[0] and y - half <= box[3] and y + half > box[1]:
                ring = ((x - size, y), (x - size / 2, y - half), (x + size / 2, y - half), (x + size, y), (x + size / 2, y + half), (x - size / 2, y + half))
                out.append(((*ring, ring[0]),))
    _cells(len(out))
    return Geom(M.MULTIPOLYGON, tuple(out), bounds.srid)


def geohash(lon: float, lat: float, n: int) -> str:
    box, out, bits, value = [-180.0, 180.0, -90.0, 90.0], "", 0, 0
    while len(out) < n:
        k = 0 if (bits + 5 * len(out)) % 2 == 0 else 2
        mid = (box[k] + box[k + 1]) / 2
        high = (lon if k == 0 else lat) >= mid
        box[k if high else k + 1] = mid
        value, bits = value * 2 + high, bits + 1
        if bits == 5:
            out, bits, value = out + BASE32[value], 0, 0
    return out


@fn("ST_GeoHash", "g", "g,int", returns="string")
def st_geohash(g, n=20):
    box = M.envelope(g)
    if box is None:
        return None
    if box[0] < -180 or box[1] < -90 or box[2] > 180 or box[3] > 90:
        raise GeometryError("ST_GeoHash needs coordinates in degrees")
    n = max(1, min(20, n))
    if box[0] == box[2] and box[1] == box[3]:
        return geohash(box[0], box[1], n)
    low, high = geohash(box[0], box[1], 20), geohash(box[2], box[3], 20)
    same = next((k for k, (a, b) in enumerate(zip(low, high, strict=True)) if a != b), 20)
    return geohash((box[0] + box[2]) / 2, (box[1] + box[3]) / 2, 20)[:same][:n]


def _hash_box(text: str, n: int | None):
    text = text.lower()[: n if n is not None and n >= 0 else None]
    box, even = [-180.0, 180.0, -90.0, 90.0], True
    for c in text:
        v = BASE32.find(c)
        if v < 0:
            raise GeometryError(f"invalid geohash character {c!r}")
        for b in (16, 8, 4, 2, 1):
            k = 0 if even else 2
            mid = (box[k] + box[k + 1]) / 2
            box[k if v & b else k + 1] = mid
            even = not even
    return box


@fn("ST_GeomFromGeoHash", "text", "text,int")
def geom_from_geohash(t, n=None):
    a, b, c, d = _hash_box(t, n)
    return M.box_polygon((a, c, b, d), 4326)


fn("ST_Box2dFromGeoHash", "text")(geom_from_geohash)


@fn("ST_PointFromGeoHash", "text", "text,int")
def point_from_geohash(t, n=None):
    a, b, c, d = _hash_box(t, n)
    return M.point((a + b) / 2, (c + d) / 2, 4326)


# -- H3 --------------------------------------------------------------------
@fn("h3_latlng_to_cell", "g,int", returns="bigint")
def h3_latlng_to_cell(g, res):
    if g.kind != M.POINT or not g.data:
        raise GeometryError("h3_latlng_to_cell takes a POINT that is not empty")
    if g.srid not in (0, 4326):
        raise GeometryError("h3_latlng_to_cell takes longitude and latitude (EPSG:4326)")
    if not 0 <= res <= 15:
        raise GeometryError("an H3 resolution lies between 0 and 15")
    return h3.cell(g.data[0], g.data[1], res)


def _h3_valid(c: int) -> int:
    u = c & (1 << 64) - 1
    if u >> 63 or (u >> 59) & 15 != 1 or (u >> 45) & 127 > 121:
        raise GeometryError("not an H3 cell")
    return u


@fn("h3_cell_to_parent", "bigint,int", returns="bigint")
def h3_cell_to_parent(c, res):
    u = _h3_valid(c)
    own = (u >> 52) & 15
    if not 0 <= res <= own:
        raise GeometryError("the parent's resolution must be coarser, 0 or more")
    u = u & ~(15 << 52) | res << 52
    for r in range(res + 1, 16):
        u |= 7 << 3 * (15 - r)
    return u


@fn("h3_cell_to_string", "bigint", returns="string")
def h3_cell_to_string(c):
    return f"{c & (1 << 64) - 1:x}"


@fn("h3_string_to_cell", "text", returns="bigint")
def h3_string_to_cell(t):
    try:
        u = int(t, 16)
    except ValueError as e:
        raise GeometryError("not an H3 cell") from e
    _h3_valid(u)
    return u
