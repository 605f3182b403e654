"""Registration of the catalogue as Arrow-batched SQL functions, and Column wrappers for the DataFrame API."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType

from ..core import codec, route
from ..core import model as M
from ..core.model import Geom, GeometryError
from . import FUNCTIONS, Function, batch
from .areal import union_all
from .formats import encode_tile

TYPES = {"binary": BinaryType(), "string": StringType(), "double": DoubleType(), "int": IntegerType(), "bigint": LongType(), "boolean": BooleanType()}
ARROW = {"binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
#: Functions that exist only to say what to use instead.
STUBS = {"ST_Collect": "ST_Collect is not supported: use collect_list(geom), or ST_Union_Agg(geom) to dissolve"}


def _series(name: str, quiet: bool):
    """The function over Arrow columns; the function is looked up by name in the worker."""
    out = ARROW[FUNCTIONS[name].returns]

    def by_row(*columns: pa.Array) -> pa.Array:
        call = FUNCTIONS[name].call
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        if not quiet:
            return pa.array([call(*r) for r in rows], out)
        values = []
        for r in rows:
            try:
                values.append(call(*r))
            except GeometryError:
                values.append(None)
        return pa.array(values, out)

    def run(*columns: pa.Array) -> pa.Array:
        whole = batch.run(name, columns, by_row) if any(len(s) == len(columns) for s in FUNCTIONS[name].signatures) else None
        return by_row(*columns) if whole is None else whole.cast(out)

    run.__name__ = name
    return run


def udf(name: str, quiet: bool = False):
    """The vectorised function of a catalogue entry; ``quiet`` turns errors into nulls."""
    return F.arrow_udf(_series(name, quiet), TYPES[FUNCTIONS[name].returns])


def call(name: str, *columns, quiet: bool = False) -> Column:
    """A Column that applies a catalogue function."""
    f = FUNCTIONS[name]
    if not any(len(s) == len(columns) for s in f.signatures):
        raise GeometryError(f"{name} does not take {len(columns)} arguments")
    return udf(name, quiet)(*[c if isinstance(c, Column) else F.col(c) for c in columns])


# -- aggregates ------------------------------------------------------------
def _complete(*series):
    """Rows without a null in any column."""
    return [r for r in zip(*series, strict=True) if not any(v is None or v is pd.NA or (isinstance(v, float) and v != v) for v in r)]


def _constant(values, what: str):
    seen = set(values)
    if len(seen) > 1:
        raise GeometryError(f"{what} must be the same in all rows of a group")
    return next(iter(seen), None)


def union_agg(g: pd.Series) -> bytes:
    out = union_all([codec.decode(b) for b in g if b is not None])
    return None if out is None else codec.encode(out)


def _sides(g: pd.Series, names: tuple[str, ...]):
    """Sides of the boxes of a group, by whole batches; not a number where a geometry is empty."""
    column = pa.array([b for b in g if b is not None], pa.binary())
    return column, [_series(n, False)(column).to_numpy(zero_copy_only=False).astype(float) for n in names]


def extent_agg(g: pd.Series) -> bytes:
    column, (x0, y0, x1, y1) = _sides(g, ("ST_MinX", "ST_MinY", "ST_MaxX", "ST_MaxY"))
    some = x0 == x0
    if not some.any():
        return None
    srids = _series("ST_SRID", False)(column).to_numpy(zero_copy_only=False)
    known = srids[srids > 0]
    return codec.encode(M.box_polygon((float(x0[some].min()), float(y0[some].min()), float(x1[some].max()), float(y1[some].max())), int(known[0]) if len(known) else 0))


def extent_3d_agg(g: pd.Series) -> str:
    column, sides = _sides(g, ("ST_XMin", "ST_YMin", "ST_ZMin", "ST_XMax", "ST_YMax", "ST_ZMax"))
    some = sides[0] == sides[0]
    if not some.any():
        return None
    for k in (2, 5):
        sides[k][sides[k] != sides[k]] = 0.0  # a geometry without heights stands at 0
    n = lambda p: " ".join(codec.number(float(x)) for x in p)
    return f"BOX3D({n(v[some].min() for v in sides[:3])},{n(v[some].max() for v in sides[3:])})"


def as_mvt_agg(*cols: pd.Series) -> bytes:
    rows = _complete(*cols[:1], *cols[1:])
    if not rows:
        return None
    name = _constant([r[1] for r in rows], "the layer name") if len(cols) > 1 else "default"
    extent = int(_constant([r[2] for r in rows], "the extent")) if len(cols) > 2 else 4096
    features = [(codec.decode(r[0]), json.loads(r[3]) if len(cols) > 3 else {}) for r in rows]
    return encode_tile(features, name, extent)


def _graph(cols, ends: int):
    """(graph, then the values of the two columns after the edges') of rows without a null; None without rows.

    The columns are those of an edge (an id is made up if ``ends`` is 3), then two constants, then perhaps the cost back."""
    import numpy as np

    whole = pd.concat(cols, axis=1).notna().all(axis=1).to_numpy()
    if not whole.any():
        return None
    values = [c.to_numpy()[whole] for c in cols]
    ids = np.zeros(int(whole.sum()), np.int64) if ends == 3 else values[0]
    back = values[ends + 2] if len(cols) > ends + 2 else None
    return (route.Graph(ids, *values[ends - 3 : ends], back), values[ends], values[ends + 1])


def _rows_json(names, rows):
    return None if rows is None else json.dumps([dict(zip(names, r, strict=True)) for r in rows], separators=(",", ":"))


def dijkstra_agg(*cols: pd.Series) -> str:
    made = _graph(cols, 4)
    if made is None:
        return None
    g, start, end = made
    a, b = _constant(start.tolist(), "start"), _constant(end.tolist(), "end")
    return _rows_json(("seq", "node", "edge", "cost", "agg_cost"), route.shortest_path(g, int(a), int(b)))


def dijkstra_cost_agg(*cols: pd.Series) -> float:
    made = _graph(cols, 3)
    if made is None:
        return None
    g, start, end = made
    a, b = _constant(start.tolist(), "start"), _constant(end.tolist(), "end")
    return route.path_cost(g, int(a), int(b))


def driving_distance_agg(*cols: pd.Series) -> str:
    made = _graph(cols, 4)
    if made is None:
        return None
    g, start, limit = made
    names = ("seq", "depth", "start_vid", "pred", "node", "edge", "cost", "agg_cost")
    return _rows_json(names, route.driving_distance(g, int(_constant(start.tolist(), "start")), float(_constant(limit.tolist(), "the limit"))))


#: Grouped aggregates by SQL name: function and return type.
AGGREGATES = {
    "ST_Union_Agg": (union_agg, "binary"),
    "ST_Extent": (extent_agg, "binary"),
    "ST_3DExtent": (extent_3d_agg, "string"),
    "ST_AsMVT": (as_mvt_agg, "binary"),
    "route_dijkstra": (dijkstra_agg, "string"),
    "route_dijkstra_cost": (dijkstra_cost_agg, "double"),
    "route_driving_distance": (driving_distance_agg, "string"),
}


def aggregate(name: str):
    """A grouped-aggregate function (all rows of a group meet in one task; the operators
    in ``operators.aggregate`` aggregate in two phases)."""
    f, kind = AGGREGATES[name]
    if kind == "binary":  # pandas keeps bytes as objects

        def run(*c: pd.Series) -> bytes:
            return f(*c)
    elif kind == "string":

        def run(*c: pd.Series) -> str:
            return f(*c)
    else:

        def run(*c: pd.Series) -> float:
            return f(*c)

    return F.pandas_udf(run, TYPES[kind])


def _stub(message: str):
    def run(*columns: pa.Array) -> pa.Array:
        raise GeometryError(message)

    return F.arrow_udf(run, BinaryType())


# -- table functions -------------------------------------------------------
class Dump:
    """(path, geom) of every single member."""

    def eval(self, g):
        if g is not None:
            for k, s in enumerate(M.members(codec.decode(bytes(g))), 1):
                yield k, codec.encode(s)


class DumpPoints:
    """(path, geom) of every vertex."""

    def eval(self, g):
        if g is not None:
            v = codec.decode(bytes(g))
            for k, c in enumerate(M.coords(v), 1):
                yield k, codec.encode(Geom(M.POINT, c, v.srid, v.z, v.m))


class SubdivideRows:
    """(path, geom) of the pieces of ST_Subdivide."""

    def eval(self, g, most: int):
        if g is not None:
            for k, d in enumerate(FUNCTIONS["ST_Subdivide"].kernel(codec.decode(bytes(g)), most).data, 1):
                yield k, codec.encode(Geom(M.POLYGON, d))


class SquareGridRows:
    """(i, j, geom) of the cells of a square grid over bounds; the cells stream, without a limit."""

    def eval(self, size: float, g):
        box = None if g is None else M.envelope(codec.decode(bytes(g)))
        if box is None or not size > 0:
            return
        import math

        for i in range(math.floor(box[0] / size), math.floor(box[2] / size) + 1):
            for j in range(math.floor(box[1] / size), math.floor(box[3] / size) + 1):
                yield i, j, codec.encode(M.box_polygon((i * size, j * size, (i + 1) * size, (j + 1) * size)))


TABLES = {"ST_Dump": (Dump, "path: int, geom: binary"), "ST_DumpPoints": (DumpPoints, "path: int, geom: binary"), "ST_SubdivideRows": (SubdivideRows, "path: int, geom: binary"), "ST_SquareGridRows": (SquareGridRows, "i: bigint, j: bigint, geom: binary")}


def register_all(spark: SparkSession, quiet_prefix: str | None = "try_") -> list[str]:
    """Registers every function, aggregate, table function and stub; returns the names.

    With ``quiet_prefix`` each scalar also gets a variant that returns null instead of an error."""
    names = []
    for name in FUNCTIONS:
        spark.udf.register(name, udf(name))
        names.append(name)
        if quiet_prefix:
            spark.udf.register(quiet_prefix + name, udf(name, True))
    for name in AGGREGATES:
        spark.udf.register(name, aggregate(name))
        names.append(name)
    for name, message in STUBS.items():
        spark.udf.register(name, _stub(message))
        names.append(name)
    for name, (cls, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(cls, returnType=schema))
        names.append(name)
    return names


__all__ = ["AGGREGATES", "Function", "aggregate", "call", "register_all", "udf"]
