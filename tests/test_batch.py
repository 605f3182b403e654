"""Whole-batch forms against the row-wise kernels, on columns of every make."""

import math
import random

import pyarrow as pa
import pytest

from geoquern.core import codec
from geoquern.core import model as M
from geoquern.core.model import GeometryError
from geoquern.functions import FUNCTIONS
from geoquern.functions.batch import BATCH
from geoquern.functions.register import _series


def column(rng, make, n):
    """Values of one kind, of several kinds, with nulls, and constants."""
    kind = make
    if kind == "mixed":
        pick = lambda: geometry(rng, rng.choice(["point", "line", "rect", "ring", "far", "holed", "multi", "empty", None]))
    elif kind == "constant":
        value = geometry(rng, "ring", srid=0)
        pick = lambda: value
    elif kind == "sized":
        pick = lambda: geometry(rng, rng.choice(["line", "ring"]))
    else:
        pick = lambda: None if rng.random() < 0.1 else geometry(rng, kind, srid=0)
    return [pick() for _ in range(n)]


def geometry(rng, kind, srid=None):
    if kind is None:
        return None
    x, y = rng.randint(-9, 9) + rng.choice([0, 0, 0.5, 0.1]), rng.randint(-9, 9)
    w, h = rng.randint(1, 6), rng.randint(1, 6)
    pts = {
        "point": (x, y), "line": tuple((x + rng.randint(-5, 5), y + k) for k in range(rng.choice([2, 2, 3, 5]))), "rect": (((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)),),
        "ring": (((x, y), (x + w, y), (x + w + 1, y + h), (x, y + h + 1), (x, y)),), "far": (((x + 90, y), (x + 95, y), (x + 93, y + 4), (x + 90, y)),), "holed": (((x, y), (x + 9, y), (x + 9, y + 9), (x, y + 9), (x, y)), ((x + 1, y + 1), (x + 1, y + 2), (x + 2, y + 2), (x + 1, y + 1))),
        "multi": ((x, y), (x + 1, y)), "empty": (),
    }[kind]
    number = {"point": M.POINT, "line": M.LINESTRING, "multi": M.MULTIPOINT, "empty": M.LINESTRING}.get(kind, M.POLYGON)
    return codec.encode(M.Geom(number, pts, rng.choice([0, 0, 4326]) if srid is None else srid))


def argument(rng, kind, name, make, n):
    if kind in ("g", "blob", "gtext", "gbox"):
        if name in ("ST_GeomFromWKB", "ST_GeomFromEWKB"):
            return [None if g is None else codec.wkb(codec.decode(g)) for g in column(rng, make, n)]
        return column(rng, make, n)
    if kind == "text":
        return [None if g is None else codec.wkt(codec.decode(g)) for g in column(rng, make, n)]
    if kind == "dbl":
        return [rng.choice([0.0, 0.25, 0.5, 1.0, 2.0, None]) if make == "mixed" else rng.choice([0.25, 0.5, 1.0]) for _ in range(n)]
    if name == "ST_Transform":
        return [3857] * n
    if name == "ST_PointN":
        return [rng.choice([1, 2])] * n
    return [4326] * n


def plain(v):
    if isinstance(v, bytes):
        g = codec.decode(v) if v else None
        return (g.kind, g.srid, tuple(round(c, 7) + 0.0 for p in M.coords(g) for c in p)) if g else v
    return round(v, 7) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


KINDS = {"g": pa.binary(), "blob": pa.binary(), "gtext": pa.binary(), "gbox": pa.binary(), "text": pa.string(), "dbl": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}


@pytest.mark.parametrize("name", sorted(BATCH))
def test_batch_form_agrees(name):
    rng = random.Random(name)
    whole = _series(name, True)
    for signature in FUNCTIONS[name].signatures:
        for make in ("point", "line", "rect", "ring", "sized", "mixed", "constant"):
            for second in ("point", "rect", "mixed", "constant"):
                args = [argument(rng, k, name, make if i == 0 else second, 60) for i, k in enumerate(signature)]
                if name == "ST_Transform":
                    args[0] = [None if g is None else FUNCTIONS["ST_SetSRID"].call(g, 4326) for g in args[0]]
                want = []
                for row in zip(*args, strict=True):
                    try:
                        want.append(FUNCTIONS[name].call(*row))
                    except GeometryError:
                        want.append(None)
                got = whole(*(pa.array(a, KINDS[k]) for a, k in zip(args, signature, strict=True))).to_pylist()
                assert [plain(v) for v in got] == [plain(v) for v in want], (make, second)
                if sum(k in ("g", "blob") for k in signature) < 2:
                    break


def test_common_calls_run_as_whole_batches():
    """No row-wise kernel is called for points, lines, rings and rectangles, nulls among them."""
    rng = random.Random(1)

    def refuse(*columns):
        raise AssertionError("row by row")

    from geoquern.functions import batch

    for name, make in (("ST_Area", "rect"), ("ST_Area", "sized"), ("ST_Length", "line"), ("ST_AsText", "ring"), ("ST_Centroid", "ring"), ("ST_Envelope", "rect"), ("ST_Reverse", "line"), ("ST_NPoints", "sized")):
        assert batch.run(name, (pa.array(column(rng, make, 500), pa.binary()),), refuse) is not None
    texts = [None if g is None else codec.wkt(codec.decode(g)) for g in column(rng, "line", 500)]
    assert batch.run("ST_GeomFromText", (pa.array(texts),), refuse) is not None
    a, b = pa.array(column(rng, "rect", 500), pa.binary()), pa.array(column(rng, "rect", 500), pa.binary())
    assert batch.run("ST_Overlaps", (a, b), refuse) is not None


def test_extent_aggregates_agree_with_a_loop():
    import pandas as pd

    from geoquern.functions.register import extent_3d_agg, extent_agg

    rng = random.Random(4)
    for make in ("point", "rect", "mixed"):
        values = column(rng, make, 200)
        own = [codec.decode(b) for b in values if b is not None]
        boxes = [b for b in map(M.envelope, own) if b]
        low, high = [min(b[k] for b in boxes) for k in (0, 1)], [max(b[k] for b in boxes) for k in (2, 3)]
        got = codec.decode(extent_agg(pd.Series(values, dtype=object)))
        assert M.envelope(got) == (*low, *high) and got.srid == next((g.srid for g in own if g.srid > 0), 0)
        n = codec.number
        assert extent_3d_agg(pd.Series(values, dtype=object)) == f"BOX3D({n(low[0])} {n(low[1])} 0,{n(high[0])} {n(high[1])} 0)"
    assert extent_agg(pd.Series([None, geometry(rng, "empty")], dtype=object)) is None and extent_3d_agg(pd.Series([None], dtype=object)) is None
    z = [FUNCTIONS["ST_MakePoint"].call(1.0, 2.0, v) for v in (-3.0, 7.5)] + [geometry(rng, "point", srid=0)]
    assert extent_3d_agg(pd.Series(z, dtype=object)).split(",")[0].endswith(" -3") and extent_3d_agg(pd.Series(z, dtype=object)).endswith("7.5)")
