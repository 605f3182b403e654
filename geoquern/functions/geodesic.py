"""Distances on the sphere and on a spheroid."""

from __future__ import annotations

import math
import re

from ..core import crs
from ..core import model as M
from ..core.model import GeometryError
from .basic import _xy
from .registry import fn

RADIUS = 6371008.7714


@fn("ST_DistanceSphere", "g,g", returns="double")
def distance_sphere(a, b):
    M.check_srid(a, b)
    (x0, y0), (x1, y1) = _xy(a), _xy(b)
    p0, p1 = math.radians(y0), math.radians(y1)
    h = math.sin((p1 - p0) / 2) ** 2 + math.cos(p0) * math.cos(p1) * math.sin(math.radians(x1 - x0) / 2) ** 2
    return 2 * RADIUS * math.asin(min(1.0, math.sqrt(h)))


def parse_spheroid(text: str) -> tuple[float, float]:
    m = re.fullmatch(r'\s*SPHEROID\s*\[\s*"[^"]*"\s*,\s*([-+.\deE]+)\s*,\s*([-+.\deE]+)\s*\]\s*', text, re.IGNORECASE)
    if not m or not float(m[1]) > 0 or not float(m[2]) > 0:
        raise GeometryError("a spheroid is written SPHEROID[\"name\",a,1/f] with positive numbers")
    return float(m[1]), 1 / float(m[2])


def inverse(lon1, lat1, lon2, lat2, a=crs.A, f=crs.F) -> float:
    """Length of the geodesic, by integrating along the auxiliary great circle (Vincenty's
    iteration for the longitude, which is bisected where it does not settle)."""
    if (lon1, lat1) == (lon2, lat2):
        return 0.0
    b = a * (1 - f)
    lam0 = math.radians((lon2 - lon1 + 180) % 360 - 180)
    u1, u2 = math.atan((1 - f) * math.tan(math.radians(lat1))), math.atan((1 - f) * math.tan(math.radians(lat2)))
    s1, c1, s2, c2 = math.sin(u1), math.cos(u1), math.sin(u2), math.cos(u2)
    lam = lam0
    for _ in range(1000):
        sl, cl = math.sin(lam), math.cos(lam)
        ss = math.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        if ss == 0:
            return 0.0
        cs = s1 * s2 + c1 * c2 * cl
        sigma = math.atan2(ss, cs)
        sa = c1 * c2 * sl / ss
        ca2 = 1 - sa * sa
        cm = cs - 2 * s1 * s2 / ca2 if ca2 > 1e-15 else 0.0
        k = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
        new = lam0 + (1 - k) * f * sa * (sigma + k * ss * (cm + k * cs * (2 * cm * cm - 1)))
        if abs(new) > math.pi:
            new = math.copysign(math.pi, new)
        if abs(new - lam) < 1e-14:
            break
        lam = (lam + new) / 2 if _ > 50 else new
    e2 = ca2 * (a * a - b * b) / (b * b)
    n = (math.sqrt(1 + e2) - 1) / (math.sqrt(1 + e2) + 1)
    big, k = (1 + n * n / 4) / (1 - n), n * (1 - 3 * n * n / 8)
    d = k * ss * (cm + k / 4 * (cs * (2 * cm * cm - 1) - k / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    return b * big * (sigma - d)


def published(lon1, lat1, lon2, lat2, rounds: int, a=crs.A, f=crs.F) -> float:
    """Vincenty's formulas as published, after so many rounds, in the order of operations in which SQL has them.

    Near the antipode the rounds do not settle and this is not the geodesic, which ``inverse`` gives."""
    l0 = lam = math.radians(lon2 - lon1)
    u1, u2 = math.atan((1 - f) * math.tan(math.radians(lat1))), math.atan((1 - f) * math.tan(math.radians(lat2)))
    s1, c1, s2, c2 = math.sin(u1), math.cos(u1), math.sin(u2), math.cos(u2)
    for _ in range(rounds):
        sl, cl = math.sin(lam), math.cos(lam)
        x, y = c2 * sl, c1 * s2 - s1 * c2 * cl
        ss, cs = math.sqrt(x * x + y * y), s1 * s2 + c1 * c2 * cl
        s = math.atan2(ss, cs)
        sa = c1 * c2 * sl / ss if ss else 0.0
        ca2 = 1 - sa * sa
        cm = 0.0 if sa * sa >= 1 else cs - 2 * s1 * s2 / ca2
        cc = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
        last, lam = lam, l0 + (1 - cc) * f * sa * (s + cc * ss * (cm + cc * cs * (2 * cm * cm - 1)))
        if lam == last:  # all further rounds are the same
            break
    p2 = ca2 * (1 / (1 - f) ** 2 - 1)
    big = 1 + p2 / 16384 * (4096 + p2 * (320 * p2 - 768 - 175 * p2 * p2))
    small = p2 / 1024 * (256 + p2 * (74 * p2 - 128 - 47 * p2 * p2))
    turn = small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    return a * (1 - f) * big * (s - turn)


@fn("ST_DistanceSpheroid", "g,g", "g,g,text", returns="double")
def distance_spheroid(a, b, spheroid=None):
    M.check_srid(a, b)
    return inverse(*_xy(a), *_xy(b), *(parse_spheroid(spheroid) if spheroid else ()))


@fn("ST_LengthSpheroid ST_Length2DSpheroid", "g,text", returns="double")
def length_spheroid(g, spheroid):
    s = parse_spheroid(spheroid)
    return float(sum(inverse(*p[:2], *q[:2], *s) for path in M.paths(g) for p, q in zip(path, path[1:])))
