"""The function catalogue: names, signatures, return types and kernels.

A kernel works on decoded values of one row.  Arguments are converted by kind before it
is called: ``g`` a decoded geometry, ``blob`` its bytes, ``gtext`` geometry or text,
``text``, ``int``, ``dbl``, ``bigint``, ``bool``, ``opt`` text or integer.  Any null argument
gives null without calling the kernel.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from ..core import codec
from ..core import model as M
from ..core.model import Geom, GeometryError


@dataclass(frozen=True)
class Function:
    name: str
    signatures: tuple[tuple[str, ...], ...]
    returns: str  # binary, string, double, int, bigint, boolean
    kernel: Callable
    native: str = ""  # note on a native form

    def call(self, *args):
        """The result for raw values (bytes for geometries), as the SQL function gives it."""
        kinds = next((s for s in self.signatures if len(s) == len(args)), None)
        if kinds is None:
            raise GeometryError(f"{self.name} takes {' or '.join(sorted({str(len(s)) for s in self.signatures}))} arguments, not {len(args)}")
        if any(a is None for a in args):
            return None
        return encode_result(self.kernel(*[CONVERT[k](a) for k, a in zip(kinds, args, strict=True)]))


def _int(v):
    if isinstance(v, bool) or int(v) != v:
        raise GeometryError(f"an integer is expected, not {v!r}")
    return int(v)


def _text(v):
    if not isinstance(v, str):
        raise GeometryError("text is expected")
    return v


def _blob(v):
    if isinstance(v, str):
        raise GeometryError("got text where a geometry is expected; did you mean ST_GeomFromText?")
    return bytes(v)


CONVERT = {
    "g": lambda v: codec.decode(_blob(v)),
    "blob": _blob,
    "gtext": lambda v: v if isinstance(v, str) else codec.decode(bytes(v)),
    "text": _text,
    "int": _int,
    "bigint": _int,
    "dbl": float,
    "bool": bool,
    "opt": lambda v: v if isinstance(v, str) else _int(v),
}


def encode_result(v):
    return codec.encode(v) if isinstance(v, Geom) else v


FUNCTIONS: dict[str, Function] = {}


def fn(names: str, *signatures: str, returns: str = "binary"):
    """Registers a kernel under one or more names (the further ones are aliases)."""

    def deco(kernel):
        sigs = tuple(tuple(k for k in s.split(",") if k) for s in signatures)
        for name in names.split():
            FUNCTIONS[name] = Function(name, sigs, returns, kernel)
        return kernel

    return deco


def alias(name: str, of: str, *signatures: str):
    f = FUNCTIONS[of]
    sigs = tuple(tuple(s.split(",")) for s in signatures) or f.signatures
    FUNCTIONS[name] = Function(name, sigs, f.returns, f.kernel)


# -- heights of derived results --------------------------------------------
def derive(out: Geom | None, *sources: Geom) -> Geom | None:
    """A planar result with the heights of its sources: of a vertex at the same place, else
    blended on a segment it lies on; if neither gives one height, an error."""
    if out is None or not any(s.z or s.m for s in sources) or M.is_empty(out):
        return out
    if not any(s.z for s in sources):
        return out
    if not all(s.z for s in sources if not M.is_empty(s)):
        raise GeometryError("cannot mix operands with and without Z; use ST_Force2D or ST_Force3D first")
    known: dict = {}
    segs = []
    for s in sources:
        for c in M.coords(s):
            if known.setdefault((c[0], c[1]), c[2]) != c[2]:
                raise GeometryError("two heights at one place; use ST_Force2D first")
        for p in M.paths(s):
            segs += list(zip(p, p[1:]))

    def lift(c):
        z = known.get((c[0], c[1]))
        if z is None:
            best = None
            for a, b in segs:
                dx, dy = b[0] - a[0], b[1] - a[1]
                n = dx * dx + dy * dy
                if n == 0:
                    continue
                t = ((c[0] - a[0]) * dx + (c[1] - a[1]) * dy) / n
                off = abs((c[0] - a[0]) * dy - (c[1] - a[1]) * dx) / math.sqrt(n)
                if -1e-12 <= t <= 1 + 1e-12 and off <= 1e-9 * max(1.0, abs(c[0]), abs(c[1])):
                    best = a[2] + t * (b[2] - a[2])
                    break
            if best is None:
                raise GeometryError("the result has a vertex without a height; use ST_Force2D first")
            z = best
        return (c[0], c[1], z)

    return M.map_coords(out, lift, z=True, m=False)
