"""Catalyst forms of functions on coordinate columns and boxes: no Python in the plan.

Points are pairs of double columns (x, y); boxes are structs (minx, miny, maxx, maxy).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core.crs import A
from .cells import BASE32
from .geodesic import RADIUS

Box = tuple[float, float, float, float]


def distance(x0, y0, x1, y1) -> Column:
    dx, dy = x1 - x0, y1 - y0
    return F.sqrt(dx * dx + dy * dy)


def dwithin(x0, y0, x1, y1, d) -> Column:
    dx, dy = x1 - x0, y1 - y0
    return dx * dx + dy * dy <= F.lit(d) * F.lit(d)


def azimuth(x0, y0, x1, y1) -> Column:
    two_pi = F.lit(2 * math.pi)
    return F.when((x0 != x1) | (y0 != y1), F.pmod(F.atan2(x1 - x0, y1 - y0), two_pi))


def angle(x0, y0, x1, y1, x2, y2) -> Column:
    """Clockwise angle at the middle point."""
    a, b = F.atan2(y0 - y1, x0 - x1), F.atan2(y2 - y1, x2 - x1)
    return F.when(((x0 != x1) | (y0 != y1)) & ((x2 != x1) | (y2 != y1)), F.pmod(a - b, F.lit(2 * math.pi)))


def distance_sphere(lon0, lat0, lon1, lat1) -> Column:
    p0, p1 = F.radians(lat0), F.radians(lat1)
    h = F.pow(F.sin((p1 - p0) / 2), 2) + F.cos(p0) * F.cos(p1) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def project(x, y, d, az) -> tuple[Column, Column]:
    return x + d * F.sin(az), y + d * F.cos(az)


def to_mercator(lon, lat) -> tuple[Column, Column]:
    """EPSG:4326 to 3857."""
    return F.radians(lon) * A, F.asinh(F.tan(F.radians(lat))) * A


def from_mercator(x, y) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(F.atan(F.sinh(y / A)))


def affine(x, y, a, b, d, e, xoff, yoff) -> tuple[Column, Column]:
    return a * x + b * y + xoff, d * x + e * y + yoff


def box(minx, miny, maxx, maxy) -> Column:
    return F.struct(minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy"))


def boxes_overlap(a: Column, b: Column | Box) -> Column:
    """Inclusive overlap; a constant box gives comparisons that reach the Parquet scan."""
    get = (lambda k: F.lit(float(b[("minx", "miny", "maxx", "maxy").index(k)]))) if isinstance(b, tuple) else (lambda k: b[k])
    return (a["minx"] <= get("maxx")) & (a["maxx"] >= get("minx")) & (a["miny"] <= get("maxy")) & (a["maxy"] >= get("miny"))


def box_contains(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["minx"]) & (a["maxx"] >= b["maxx"]) & (a["miny"] <= b["miny"]) & (a["maxy"] >= b["maxy"])


def pad_box(b: Column, d) -> Column:
    return box(b["minx"] - d, b["miny"] - d, b["maxx"] + d, b["maxy"] + d)


def box_wkt(b: Column) -> Column:
    """WKT of a box of whole numbers or of numbers with a short decimal form."""
    n = lambda c: F.regexp_replace(F.format_string("%.9f", c), r"\.?0+$", "")
    p = lambda x, y: F.concat(n(b[x]), F.lit(" "), n(b[y]))
    corners = [("minx", "miny"), ("minx", "maxy"), ("maxx", "maxy"), ("maxx", "miny"), ("minx", "miny")]
    return F.concat(F.lit("POLYGON(("), F.concat_ws(",", *(p(*c) for c in corners)), F.lit("))"))


def ring_area(ring: Column) -> Column:
    """Signed area of an array of (x, y) structs whose last point is the first."""
    i = F.sequence(F.lit(0), F.size(ring) - 2)
    return F.aggregate(i, F.lit(0.0), lambda s, k: s + (F.get(ring, k)["x"] * F.get(ring, k + 1)["y"] - F.get(ring, k + 1)["x"] * F.get(ring, k)["y"])) / 2


def path_length(path: Column) -> Column:
    i = F.when(F.size(path) > 1, F.sequence(F.lit(0), F.size(path) - 2)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(i, F.lit(0.0), lambda s, k: s + distance(F.get(path, k)["x"], F.get(path, k)["y"], F.get(path, k + 1)["x"], F.get(path, k + 1)["y"]))


def srid(g: Column) -> Column:
    """SRID from a little-endian GeoPackage header."""
    n = F.conv(F.hex(F.concat(*(F.substring(g, k, 1) for k in (8, 7, 6, 5)))), 16, 10).cast("long")
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n).cast("int")


def set_srid(g: Column, value: int) -> Column:
    """A little-endian GeoPackage value with another SRID; the payload stays as it is."""
    return F.concat(F.substring(g, 1, 4), F.unhex(F.lit(int(value).to_bytes(4, "little", signed=True).hex())), F.substr(g, F.lit(9)))


def is_empty(g: Column) -> Column:
    """Empty flag of a canonical GeoPackage value."""
    return F.conv(F.hex(F.substring(g, 4, 1)), 16, 10).cast("int").bitwiseAND(16) != 0


def geohash(lon: Column, lat: Column, n: int) -> Column:
    """Geohash of n characters by integer arithmetic on the two bisections.

    Exact for up to 10 characters (25 bits of each axis)."""
    if not 1 <= n <= 10:
        raise ValueError("between 1 and 10 characters")
    bits = 5 * n
    nx, ny = (bits + 1) // 2, bits // 2
    ix = F.least(F.floor((lon + 180) / 360 * (1 << nx)), F.lit((1 << nx) - 1)).cast("long")
    iy = F.least(F.floor((lat + 90) / 180 * (1 << ny)), F.lit((1 << ny) - 1)).cast("long")

    def bit(k: int) -> Column:  # from the left: longitude first
        v, w = (ix, nx) if k % 2 == 0 else (iy, ny)
        return F.shiftright(v, w - 1 - k // 2).bitwiseAND(1)

    out = []
    for c in range(n):
        v = sum((bit(5 * c + j) * (1 << (4 - j)) for j in range(5)), F.lit(0))
        out.append(F.substring(F.lit(BASE32), v.cast("int") + 1, F.lit(1)))
    return F.concat(*out)


def relate_match(matrix: Column, pattern: str) -> Column:
    """Does a DE-9IM matrix satisfy a pattern."""
    return matrix.rlike("^" + "".join({"*": ".", "T": "[012]"}.get(c, c) for c in pattern.upper()) + "$")


def h3_parent(cell: Column, res: int) -> Column:
    """Coarser H3 cell: the resolution bits replaced and the finer digits filled with sevens."""
    fill = sum(7 << 3 * (15 - r) for r in range(res + 1, 16))
    keep = ~(15 << 52) & ((1 << 64) - 1)
    return cell.bitwiseAND(F.lit(keep - (1 << 64)).cast("long")).bitwiseOR(F.lit(res << 52 | fill).cast("long"))


def h3_string(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def tile_xy(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of a Web-Mercator tile."""
    n = 1 << zoom
    top = F.lit(85.05112878)
    lat = F.greatest(F.least(lat, top), -top)
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.floor(v), F.lit(n - 1))).cast("long")
    r = F.radians(lat)
    return clamp((lon + 180) / 360 * n), clamp((1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n)


def tile_cover(b: Column, zoom: int, max_cells: int | None = None) -> Column:
    """Array of tile ids (y * 2**zoom + x) that a box touches; [-1] if they are more than ``max_cells``."""
    x0, y0 = tile_xy(b["minx"], b["maxy"], zoom)
    x1, y1 = tile_xy(b["maxx"], b["miny"], zoom)
    ids = F.flatten(F.transform(F.sequence(y0, y1), lambda y: F.transform(F.sequence(x0, x1), lambda x: y * (1 << zoom) + x)))
    if max_cells is None:
        return ids
    return F.when((x1 - x0 + 1) * (y1 - y0 + 1) > max_cells, F.array(F.lit(-1).cast("long"))).otherwise(ids)


def square_cells(b: Column, size: float) -> Column:
    """Array of (i, j) of the origin-anchored square cells that a box touches."""
    lo, hi = (lambda k: F.floor(b[k] / size).cast("long")), (lambda k: F.floor(b[k] / size).cast("long"))
    return F.flatten(F.transform(F.sequence(lo("minx"), hi("maxx")), lambda i: F.transform(F.sequence(lo("miny"), hi("maxy")), lambda j: F.struct(i.alias("i"), j.alias("j")))))
