"""Gridless reprojection between coordinate systems of the EPSG register, over arrays.

A system is an ellipsoid, a shift of its datum against WGS 84 (none for the modern ones, which count as equal)
and a projection with parameters.  Series of zones follow from rules, single systems from a table.
Places go to degrees on the source's ellipsoid, through geocentric coordinates if a datum shifts, and out again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from .model import GeometryError

# Semi-major axis and inverse flattening of ellipsoids (0: a sphere).
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "bessel": (6377397.155, 299.1528128), "airy": (6377563.396, 299.3249646), "intl": (6378388.0, 297.0),
    "krass": (6378245.0, 298.3), "sphere": (6371228.0, 0.0),
}
A, F = ELLIPSOIDS["WGS84"][0], 1 / ELLIPSOIDS["WGS84"][1]
# Ellipsoid and shift to WGS 84 of datums (metres; then, for seven, arc seconds and parts in a million).
DATUMS = {
    "WGS84": ("WGS84", ()), "GRS80": ("GRS80", ()), "sphere": ("sphere", ()), "osgb36": ("airy", (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)), "dhdn": ("bessel", (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)),
    "rd": ("bessel", (565.237, 50.0087, 465.658, -0.406857, 0.350733, -1.87035, 4.0812)), "ch1903": ("bessel", (674.374, 15.056, 405.346)), "ed50": ("intl", (-87.0, -98.0, -121.0)), "tokyo": ("bessel", (-146.414, 507.337, 680.507)),
    "bd72": ("intl", (-106.8686, 52.2978, -103.7239, 0.3366, -0.457, 1.8422, -1.2747)), "ggrs87": ("GRS80", (-199.87, 74.79, 246.62)),
}
# Datum and projection of single codes.
SYSTEMS = """
4326 WGS84 degrees
4258 GRS80 degrees
4269 GRS80 degrees
4283 GRS80 degrees
7844 GRS80 degrees
4167 GRS80 degrees
4612 GRS80 degrees
6668 GRS80 degrees
4674 GRS80 degrees
4490 GRS80 degrees
4617 GRS80 degrees
4171 GRS80 degrees
4277 osgb36 degrees
4314 dhdn degrees
4289 rd degrees
4230 ed50 degrees
4149 ch1903 degrees
4301 tokyo degrees
3857 WGS84 web
3395 WGS84 merc
3832 WGS84 merc lon0=150
3994 WGS84 merc lon0=100 ts=-41
4087 WGS84 eqc
6933 WGS84 cea ts=30
3410 sphere cea ts=30
27700 osgb36 tm lat0=49 lon0=-2 k=0.9996012717 x0=400000 y0=-100000
2193 GRS80 tm lon0=173 k=0.9996 x0=1600000 y0=10000000
3006 GRS80 tm lon0=15 k=0.9996 x0=500000
3067 GRS80 tm lon0=27 k=0.9996 x0=500000
2180 GRS80 tm lon0=19 k=0.9993 x0=500000 y0=-5300000
3763 GRS80 tm lat0=39.66825833333333 lon0=-8.133108333333334
5186 GRS80 tm lat0=38 lon0=127 x0=200000 y0=600000
5179 GRS80 tm lat0=38 lon0=127.5 k=0.9996 x0=1000000 y0=2000000
3825 GRS80 tm lon0=119 k=0.9999 x0=250000
3826 GRS80 tm lon0=121 k=0.9999 x0=250000
3414 WGS84 tm lat0=1.366666666666667 lon0=103.8333333333333 x0=28001.642 y0=38744.572
2100 ggrs87 tm lon0=24 k=0.9996 x0=500000
2154 GRS80 lcc lat1=49 lat2=44 lat0=46.5 lon0=3 x0=700000 y0=6600000
3034 GRS80 lcc lat1=35 lat2=65 lat0=52 lon0=10 x0=4000000 y0=2800000
3978 GRS80 lcc lat1=49 lat2=77 lat0=49 lon0=-95
3347 GRS80 lcc lat1=49 lat2=77 lat0=63.390675 lon0=-91.86666666666666 x0=6200000 y0=3000000
3812 GRS80 lcc lat1=49.83333333333334 lat2=51.16666666666666 lat0=50.797815 lon0=4.359215833333333 x0=649328 y0=665262
31370 bd72 lcc lat1=51.16666723333333 lat2=49.8333339 lat0=90 lon0=4.367486666666666 x0=150000.013 y0=5400088.438
3111 GRS80 lcc lat1=-36 lat2=-38 lat0=-37 lon0=145 x0=2500000 y0=2500000
3112 GRS80 lcc lat1=-18 lat2=-36 lon0=134
3308 GRS80 lcc lat1=-30.75 lat2=-35.75 lat0=-33.25 lon0=147 x0=9300000 y0=4500000
5070 GRS80 aea lat1=29.5 lat2=45.5 lat0=23 lon0=-96
3577 GRS80 aea lat1=-18 lat2=-36 lon0=132
3005 GRS80 aea lat1=50 lat2=58.5 lat0=45 lon0=-126 x0=1000000
3338 GRS80 aea lat1=55 lat2=65 lat0=50 lon0=-154
3310 GRS80 aea lat1=34 lat2=40.5 lon0=-120 y0=-4000000
3035 GRS80 laea lat0=52 lon0=10 x0=4321000 y0=3210000
6931 WGS84 laea lat0=90
6932 WGS84 laea lat0=-90
3408 sphere laea lat0=90
3409 sphere laea lat0=-90
3571 WGS84 laea lat0=90 lon0=180
3572 WGS84 laea lat0=90 lon0=-150
3573 WGS84 laea lat0=90 lon0=-100
3574 WGS84 laea lat0=90 lon0=-40
3575 WGS84 laea lat0=90 lon0=10
3576 WGS84 laea lat0=90 lon0=90
3031 WGS84 stere lat0=-90 ts=-71
3413 WGS84 stere lat0=90 ts=70 lon0=-45
3995 WGS84 stere lat0=90 ts=71
3976 WGS84 stere lat0=-90 ts=-70
32661 WGS84 stere lat0=90 k=0.994 x0=2000000 y0=2000000
32761 WGS84 stere lat0=-90 k=0.994 x0=2000000 y0=2000000
28992 rd sterea lat0=52.15616055555555 lon0=5.38763888888889 k=0.9999079 x0=155000 y0=463000
2056 ch1903 somerc lat0=46.95240555555556 lon0=7.439583333333333 x0=2600000 y0=1200000
21781 ch1903 somerc lat0=46.95240555555556 lon0=7.439583333333333 x0=600000 y0=200000
"""
# Origins (latitude, longitude) of the nineteen zones of the Japanese plane coordinates.
JAPAN = (
    (33, 129.5), (33, 131), (36, 132 + 1 / 6), (33, 133.5), (36, 134 + 1 / 3), (36, 136), (36, 137 + 1 / 6), (36, 138.5), (36, 139 + 5 / 6), (40, 140 + 5 / 6),
    (44, 140.25), (44, 142.25), (44, 144.25), (26, 142), (26, 127.5), (26, 124), (26, 131), (20, 136), (26, 154),
)
#: Transverse Mercator zones of six degrees: first code, last code, zone of the first, datum, south.
ZONES = (
    (32601, 32660, 1, "WGS84", False), (32701, 32760, 1, "WGS84", True), (25828, 25838, 28, "GRS80", False), (26901, 26923, 1, "GRS80", False), (28348, 28358, 48, "GRS80", True),
    (7846, 7859, 46, "GRS80", True), (31965, 31976, 11, "GRS80", False), (31977, 31985, 17, "GRS80", True), (23028, 23038, 28, "ed50", False),
)


@dataclass(frozen=True)
class System:
    datum: str
    kind: str
    p: dict = field(hash=False)


@lru_cache(maxsize=1)
def _table() -> dict[int, System]:
    out = {}
    for line in SYSTEMS.split("\n"):
        if line:
            code, datum, kind, *rest = line.split()
            out[int(code)] = System(datum, kind, {k: float(v) for k, v in (x.split("=") for x in rest)})
    return out


def system(srid: int) -> System:
    if srid in _table():
        return _table()[srid]
    for first, last, zone, datum, south in ZONES:
        if first <= srid <= last:
            return System(datum, "tm", {"lon0": (zone + srid - first) * 6 - 183, "k": 0.9996, "x0": 500_000.0, "y0": 10_000_000.0 if south else 0.0})
    for first in (2443, 6669):
        if first <= srid <= first + 18:
            lat0, lon0 = JAPAN[srid - first]
            return System("GRS80", "tm", {"lat0": lat0, "lon0": lon0, "k": 0.9999})
    if 31466 <= srid <= 31469:
        zone = srid - 31464
        return System("dhdn", "tm", {"lon0": 3.0 * zone, "x0": zone * 1e6 + 500_000.0})
    raise GeometryError(f"EPSG:{srid} is not supported")


# -- latitudes -------------------------------------------------------------
def _e(datum: str) -> tuple[float, float]:
    """Semi-major axis and eccentricity."""
    a, inverse = ELLIPSOIDS[DATUMS[datum][0]]
    f = 1 / inverse if inverse else 0.0
    return a, math.sqrt(f * (2 - f))


def _conformal(phi, e):
    """sinh of the isometric latitude."""
    t = np.tan(phi)
    if e == 0:
        return t
    sg = np.sinh(e * np.arctanh(e * np.sin(phi)))
    return t * np.hypot(1, sg) - sg * np.hypot(1, t)


def _geodetic(tau1, e):
    """The latitude of a sinh of the isometric latitude, by Newton's method."""
    tau = tau1 / (1 - e * e)
    for _ in range(6):
        sg = np.sinh(e * np.arctanh(e * tau / np.hypot(1, tau)))
        t = tau * np.hypot(1, sg) - sg * np.hypot(1, tau)
        tau = tau + (tau1 - t) / np.hypot(1, t) * (1 + (1 - e * e) * tau * tau) / ((1 - e * e) * np.hypot(1, tau))
    return np.arctan(tau)


def _m(phi, e):
    return np.cos(phi) / np.sqrt(1 - (e * np.sin(phi)) ** 2)


def _q(phi, e):
    """Twice the sine of the authalic latitude, unnormed."""
    s = np.sin(phi)
    if e == 0:
        return 2 * s
    return (1 - e * e) * (s / (1 - (e * s) ** 2) + np.arctanh(e * s) / e)


def _from_q(q, e):
    """The latitude of an authalic value, by Newton's method on the sine."""
    s = np.clip(q / _q(math.pi / 2, e), -1, 1)
    if e == 0:
        return np.arcsin(s)
    for _ in range(8):  # the derivative of q by the sine is 2 (1 - e^2) / (1 - e^2 s^2)^2
        w = 1 - (e * s) ** 2
        s = np.clip(s + (q - (1 - e * e) * (s / w + np.arctanh(e * s) / e)) * w * w / (2 * (1 - e * e)), -1, 1)
    return np.arcsin(s)


# -- projections: (forward, inverse) on radians of longitude from the axis and latitude ----
def _tm(p, a, e):
    """Kruger's series to the sixth order of the third flattening n (fixed coefficients)."""
    f = 1 - math.sqrt(1 - e * e)
    n = f / (2 - f)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    )
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    )
    r = p.get("k", 1.0) * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)

    def plane(lam, phi):
        t = _conformal(phi, e)
        xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam)))
        x, y = eta, xi
        for j, c in enumerate(alpha, 1):
            x = x + c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
            y = y + c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        return r * x, r * y

    north = float(plane(0.0, math.radians(p["lat0"]))[1]) if p.get("lat0") else 0.0

    def forward(lam, phi):
        x, y = plane(lam, phi)
        return x, y - north

    def inverse(x, y):
        xi, eta = (y + north) / r, x / r
        u, v = xi, eta
        for j, c in enumerate(beta, 1):
            u = u - c * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
            v = v - c * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        return np.arctan2(np.sinh(v), np.cos(u)), _geodetic(np.sin(u) / np.hypot(np.sinh(v), np.cos(u)), e)

    return forward, inverse


def _poles(phi):
    if np.any(np.abs(phi) >= math.pi / 2 - 1e-15):
        raise GeometryError("a pole cannot be projected by a Mercator projection")


def _web(p, a, e):
    def forward(lam, phi):
        _poles(phi)
        return a * lam, a * np.arcsinh(np.tan(phi))

    return forward, lambda x, y: (x / a, np.arctan(np.sinh(y / a)))


def _merc(p, a, e):
    k = a * _m(math.radians(p.get("ts", 0.0)), e)

    def forward(lam, phi):
        _poles(phi)
        return k * lam, k * np.arcsinh(_conformal(phi, e))

    return forward, lambda x, y: (x / k, _geodetic(np.sinh(y / k), e))


def _eqc(p, a, e):
    return lambda lam, phi: (a * lam, a * phi), lambda x, y: (x / a, y / a)


def _cea(p, a, e):
    k = float(_m(math.radians(p.get("ts", 0.0)), e))
    return lambda lam, phi: (a * k * lam, a * _q(phi, e) / (2 * k)), lambda x, y: (x / (a * k), _from_q(2 * k * y / a, e))


def _lcc(p, a, e):
    t = lambda phi: np.exp(-np.arcsinh(_conformal(phi, e)))
    f1, f2 = math.radians(p["lat1"]), math.radians(p["lat2"])
    n = float(math.log(_m(f1, e) / _m(f2, e)) / math.log(t(f1) / t(f2))) if f1 != f2 else math.sin(f1)
    big = float(_m(f1, e) / (n * t(f1) ** n)) * a
    lat0 = p.get("lat0", 0.0)
    r0 = 0.0 if abs(lat0) == 90 else float(big * t(math.radians(lat0)) ** n)

    def forward(lam, phi):
        r = big * t(phi) ** n
        return r * np.sin(n * lam), r0 - r * np.cos(n * lam)

    def inverse(x, y):
        sign = math.copysign(1, n)
        r = sign * np.hypot(x, r0 - y)
        return np.arctan2(sign * x, sign * (r0 - y)) / n, _geodetic(np.sinh(-np.log(np.maximum(r / big, 1e-300)) / n), e)

    return forward, inverse


def _aea(p, a, e):
    f1, f2 = math.radians(p["lat1"]), math.radians(p["lat2"])
    n = float((_m(f1, e) ** 2 - _m(f2, e) ** 2) / (_q(f2, e) - _q(f1, e))) if f1 != f2 else math.sin(f1)
    c = float(_m(f1, e) ** 2 + n * _q(f1, e))
    r0 = a * math.sqrt(c - n * float(_q(math.radians(p.get("lat0", 0.0)), e))) / n

    def forward(lam, phi):
        r = a * np.sqrt(np.maximum(c - n * _q(phi, e), 0)) / n
        return r * np.sin(n * lam), r0 - r * np.cos(n * lam)

    def inverse(x, y):
        sign = math.copysign(1, n)
        r = np.hypot(x, r0 - y)
        return np.arctan2(sign * x, sign * (r0 - y)) / n, _from_q((c - (r * n / a) ** 2) / n, e)

    return forward, inverse


def _laea(p, a, e):
    lat0, qp = math.radians(p["lat0"]), float(_q(math.pi / 2, e))
    if abs(p["lat0"]) == 90:
        sign = math.copysign(1, p["lat0"])

        def forward(lam, phi):
            r = a * np.sqrt(np.maximum(qp - sign * _q(phi, e), 0))
            return r * np.sin(lam), -sign * r * np.cos(lam)

        return forward, lambda x, y: (np.arctan2(x, -sign * y), _from_q(sign * (qp - (x * x + y * y) / (a * a)), e))
    b0, rq = math.asin(float(_q(lat0, e)) / qp), a * math.sqrt(qp / 2)
    d = a * float(_m(lat0, e)) / (rq * math.cos(b0))

    def oblique(lam, phi):
        b = np.arcsin(np.clip(_q(phi, e) / qp, -1, 1))
        k = rq * np.sqrt(2 / np.maximum(1 + math.sin(b0) * np.sin(b) + math.cos(b0) * np.cos(b) * np.cos(lam), 1e-300))
        return k * d * np.cos(b) * np.sin(lam), k / d * (math.cos(b0) * np.sin(b) - math.sin(b0) * np.cos(b) * np.cos(lam))

    def inverse(x, y):
        u, v = x / d, y * d
        r = np.hypot(u, v)
        c = 2 * np.arcsin(np.clip(r / (2 * rq), -1, 1))
        safe = np.where(r == 0, 1.0, r)
        b = np.where(r == 0, b0, np.arcsin(np.clip(np.cos(c) * math.sin(b0) + v * np.sin(c) * math.cos(b0) / safe, -1, 1)))
        return np.arctan2(u * np.sin(c), r * math.cos(b0) * np.cos(c) - v * math.sin(b0) * np.sin(c)), _from_q(qp * np.sin(b), e)

    return oblique, inverse


def _stere(p, a, e):
    """Polar stereographic."""
    sign = math.copysign(1, p["lat0"])
    t = lambda phi: np.exp(-np.arcsinh(_conformal(phi, e)))
    if "ts" in p:
        ts = math.radians(abs(p["ts"]))
        k = a * float(_m(ts, e) / t(ts))
    else:
        k = 2 * a * p.get("k", 1.0) / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))

    def forward(lam, phi):
        r = np.where(sign * phi >= math.pi / 2, 0.0, k * t(np.minimum(sign * phi, math.pi / 2 - 1e-16)))
        return r * np.sin(lam), -sign * r * np.cos(lam)

    def inverse(x, y):
        r = np.hypot(x, y)
        return np.arctan2(x, -sign * y), np.where(r == 0, sign * math.pi / 2, sign * _geodetic(np.sinh(-np.log(np.maximum(r, 1e-300) / k)), e))

    return forward, inverse


def _sphere_of(lat0, e):
    """Gauss's conformal sphere at a latitude: radius (of a = 1), exponent, constant and latitude there."""
    s = math.sin(lat0)
    radius = math.sqrt(1 - e * e) / (1 - e * e * s * s)
    n = math.sqrt(1 + e * e * math.cos(lat0) ** 4 / (1 - e * e))
    return radius, n, s


def _sterea(p, a, e):
    """Oblique stereographic by way of the conformal sphere."""
    lat0 = math.radians(p["lat0"])
    radius, n, s = _sphere_of(lat0, e)
    w = lambda s: ((1 + s) / (1 - s) * ((1 - e * s) / (1 + e * s)) ** e) ** n
    w1 = w(s)
    c = (n + s) * (1 - (w1 - 1) / (w1 + 1)) / ((n - s) * (1 + (w1 - 1) / (w1 + 1)))
    chi0 = math.asin((c * w1 - 1) / (c * w1 + 1))
    k = 2 * a * radius * p.get("k", 1.0)

    def forward(lam, phi):
        own = c * w(np.sin(phi))
        chi, l = np.arcsin((own - 1) / (own + 1)), n * lam
        b = 1 + np.sin(chi) * math.sin(chi0) + np.cos(chi) * math.cos(chi0) * np.cos(l)
        return k * np.cos(chi) * np.sin(l) / b, k * (np.sin(chi) * math.cos(chi0) - np.cos(chi) * math.sin(chi0) * np.cos(l)) / b

    def inverse(x, y):
        r = np.hypot(x, y)
        g = 2 * np.arctan(r / k)
        safe = np.where(r == 0, 1.0, r)
        chi = np.arcsin(np.clip(np.cos(g) * math.sin(chi0) + y * np.sin(g) * math.cos(chi0) / safe, -1, 1))
        l = np.arctan2(x * np.sin(g), r * math.cos(chi0) * np.cos(g) - y * math.sin(chi0) * np.sin(g))
        psi = 0.5 * np.log((1 + np.sin(chi)) / (c * (1 - np.sin(chi)))) / n
        return l / n, _geodetic(np.sinh(psi), e)

    return forward, inverse


def _somerc(p, a, e):
    """Oblique Mercator on the conformal sphere, the axis through its centre."""
    lat0 = math.radians(p["lat0"])
    radius, alpha, s = _sphere_of(lat0, e)
    b0 = math.asin(s / alpha)
    iso = lambda phi: np.arcsinh(_conformal(phi, e))
    k = math.asinh(math.tan(b0)) - alpha * float(iso(lat0))
    r = a * radius * p.get("k", 1.0)

    def forward(lam, phi):
        l, b = alpha * lam, np.arctan(np.sinh(alpha * iso(phi) + k))
        up = np.arcsin(np.clip(math.cos(b0) * np.sin(b) - math.sin(b0) * np.cos(b) * np.cos(l), -1, 1))
        return r * np.arctan2(np.sin(l), math.sin(b0) * np.tan(b) + math.cos(b0) * np.cos(l)), r * np.arctanh(np.sin(up))

    def inverse(x, y):
        l, up = x / r, np.arctan(np.sinh(y / r))
        b = np.arcsin(np.clip(math.cos(b0) * np.sin(up) + math.sin(b0) * np.cos(up) * np.cos(l), -1, 1))
        lam = np.arctan2(np.sin(l), math.cos(b0) * np.cos(l) - math.sin(b0) * np.tan(up))
        return lam / alpha, _geodetic(np.sinh((np.arctanh(np.sin(b)) - k) / alpha), e)

    return forward, inverse


KINDS = {"tm": _tm, "web": _web, "merc": _merc, "eqc": _eqc, "cea": _cea, "lcc": _lcc, "aea": _aea, "laea": _laea, "stere": _stere, "sterea": _sterea, "somerc": _somerc}


# -- datums ----------------------------------------------------------------
def _shift(shift, x, y, z, back: bool):
    if len(shift) == 3:
        sign = -1 if back else 1
        return x + sign * shift[0], y + sign * shift[1], z + sign * shift[2]
    tx, ty, tz = shift[:3]
    rx, ry, rz = (math.radians(v / 3600) for v in shift[3:6])
    s = 1 + shift[6] * 1e-6
    if back:
        x, y, z = (x - tx) / s, (y - ty) / s, (z - tz) / s
        return x + rz * y - ry * z, -rz * x + y + rx * z, ry * x - rx * y + z
    return tx + s * (x - rz * y + ry * z), ty + s * (rz * x + y - rx * z), tz + s * (-ry * x + rx * y + z)


def _to_wgs(datum: str, lam, phi, back: bool):
    """Longitude and latitude (radians) on WGS 84 of those on the datum, or the other way."""
    shift = DATUMS[datum][1]
    (a, e), (c, g) = (_e("WGS84"), _e(datum)) if back else (_e(datum), _e("WGS84"))
    v = a / np.sqrt(1 - (e * np.sin(phi)) ** 2)
    x, y, z = _shift(shift, v * np.cos(phi) * np.cos(lam), v * np.cos(phi) * np.sin(lam), v * (1 - e * e) * np.sin(phi), back)
    r, out = np.hypot(x, y), np.arctan2(z, np.hypot(x, y) * (1 - g * g))
    for _ in range(6):
        w = c / np.sqrt(1 - (g * np.sin(out)) ** 2)
        out = np.arctan2(z + g * g * w * np.sin(out), r)
    return np.arctan2(y, x), out


# -- reprojection ----------------------------------------------------------
def _turned(lam):
    """Within half a turn of the axis."""
    return np.where(np.abs(lam) > math.pi, lam - 2 * math.pi * np.floor((lam + math.pi) / (2 * math.pi)), lam)


@lru_cache(maxsize=256)
def arrays(source: int, target: int):
    """A function (x, y) -> (x, y) over arrays."""
    own, other = system(source), system(target)
    if source == target:
        return lambda x, y: (x, y)
    shifted = own.datum != other.datum and (DATUMS[own.datum][1] or DATUMS[other.datum][1])
    inverse = None if own.kind == "degrees" else KINDS[own.kind](own.p, *_e(own.datum))[1]
    forward = None if other.kind == "degrees" else KINDS[other.kind](other.p, *_e(other.datum))[0]

    def go(x, y):
        x, y = np.asarray(x, float), np.asarray(y, float)
        if not (np.isfinite(x).all() and np.isfinite(y).all()):
            raise GeometryError("cannot transform a coordinate that is not finite")
        with np.errstate(all="ignore"):
            if inverse is None:
                lon, lat = x, y
            else:
                lam, phi = inverse(x - own.p.get("x0", 0.0), y - own.p.get("y0", 0.0))
                lon, lat = np.degrees(lam) + own.p.get("lon0", 0.0), np.degrees(phi)
                lon = np.where(np.abs(lon) > 180, lon - 360 * np.floor((lon + 180) / 360), lon) if own.kind != "web" else lon
            if shifted:
                lam, phi = np.radians(lon), np.radians(lat)
                for datum, back in ((own.datum, False), (other.datum, True)):
                    if DATUMS[datum][1]:
                        lam, phi = _to_wgs(datum, lam, phi, back)
                lon, lat = np.degrees(lam), np.degrees(phi)
            if forward is None:
                return lon, lat
            lam = np.radians(lon - other.p.get("lon0", 0.0))
            x, y = forward(lam if other.kind == "web" else _turned(lam), np.radians(lat))
        x, y = x + other.p.get("x0", 0.0), y + other.p.get("y0", 0.0)
        if not (np.isfinite(x).all() and np.isfinite(y).all()):
            raise GeometryError(f"a place has no coordinates in EPSG:{target}")
        return x, y

    return go


@lru_cache(maxsize=256)
def transformer(source: int, target: int):
    """A function (x, y) -> (x, y) of numbers."""
    f = arrays(source, target)

    def go(x, y):
        a, b = f(x, y)
        return float(a), float(b)

    return go
