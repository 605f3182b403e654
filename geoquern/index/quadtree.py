"""Quadtree cells over the whole longitude-latitude plane, numbered along a Hilbert curve.

A cell at depth d with curve position h has the id ((h << 1) | 1) << 2 (DEPTH - d): its lowest
set bit tells the depth, and the ids of its descendants are one range around it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 24
Box = tuple[float, float, float, float]


def hilbert(x: int, y: int, depth: int) -> int:
    """Position of a cell on the Hilbert curve of the given depth."""
    n, d, s = 1 << depth, 0, 1 << depth >> 1
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * ((3 * rx) ^ ry)
        if ry == 0:
            if rx:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
        s >>= 1
    return d


def cell_id(x: int, y: int, depth: int) -> int:
    return (hilbert(x, y, depth) << 1 | 1) << 2 * (DEPTH - depth)


def low_bit(cell: int) -> int:
    return cell & -cell


def cell_depth(cell: int) -> int:
    return DEPTH - (low_bit(cell).bit_length() - 1) // 2


def cell_range(cell: int) -> tuple[int, int]:
    """Ids of a cell and all its descendants."""
    b = low_bit(cell)
    return cell - b + 1, cell + b - 1


def _grid(v: float, low: float, span: float, depth: int) -> int:
    n = 1 << depth
    return max(0, min(n - 1, math.floor((v - low) / span * n)))


def cells_of(box: Box, depth: int) -> tuple[int, int, int, int]:
    return _grid(box[0], -180, 360, depth), _grid(box[1], -90, 180, depth), _grid(box[2], -180, 360, depth), _grid(box[3], -90, 180, depth)


def fit_cell(box: Box) -> int:
    """The deepest cell that holds the box."""
    for depth in range(DEPTH, -1, -1):
        x0, y0, x1, y1 = cells_of(box, depth)
        if x0 == x1 and y0 == y1:
            return cell_id(x0, y0, depth)
    return cell_id(0, 0, 0)


def quad_cover(box: Box, max_cells: int = 16, max_depth: int = DEPTH) -> list[int]:
    """At most ``max_cells`` cells that cover the box, refined where they reach out of it most."""
    depth = 0
    while depth < max_depth:
        x0, y0, x1, y1 = cells_of(box, depth + 1)
        if (x1 - x0 + 1) * (y1 - y0 + 1) > max_cells:
            break
        depth += 1
    x0, y0, x1, y1 = cells_of(box, depth)
    return sorted(cell_id(x, y, depth) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1))


def cells_for_feature(box: Box, max_cells: int = 1) -> list[int]:
    """Cells under which a feature is filed (by default the deepest one that holds it)."""
    return [fit_cell(box)] if max_cells == 1 else quad_cover(box, max_cells)


def cells_for_query(box: Box, max_cells: int = 16) -> dict:
    """``ancestors`` (ids to equal), ``ranges`` (spans of ids) and ``whole_table``."""
    cover = quad_cover(box, max_cells)
    if any(cell_depth(c) == 0 for c in cover):
        return {"ancestors": [], "ranges": [], "whole_table": True}
    spans: list[list[int]] = []
    gap = 1 << 2 * (DEPTH - max(map(cell_depth, cover))) + 1
    for lo, hi in sorted(cell_range(c) for c in cover):
        if spans and lo - spans[-1][1] <= gap:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    above = set()
    for c in cover:
        d = cell_depth(c)
        while d > 0:
            d -= 1
            b = 1 << 2 * (DEPTH - d)
            c = c & ~(2 * b - 1) | b
            above.add(c)
    return {"ancestors": sorted(above), "ranges": [tuple(s) for s in spans], "whole_table": False}


def cell_filter(box: Box, cell: Column, max_cells: int = 16) -> Column:
    """Condition on a cell column that no feature meeting the box fails; comparisons reach the scan."""
    plan = cells_for_query(box, max_cells)
    if plan["whole_table"]:
        return F.lit(True)
    out = cell.isin(plan["ancestors"])
    for lo, hi in plan["ranges"]:
        out = out | cell.between(lo, hi)
    return out


def depth_column(cell: Column) -> Column:
    """Depth of a cell column."""
    return F.lit(DEPTH) - F.floor(F.bit_count(cell.bitwiseAND(-cell) - 1) / 2).cast("int")


def fit_cell_column(box: Column) -> Column:
    """``fit_cell`` of a box column, as one expression (no Python in the plan).

    The common prefix of the corner cells' bits gives the depth; the curve is walked over that."""
    n = 1 << DEPTH

    def grid(v, low, span):
        return F.greatest(F.lit(0), F.least(F.floor((v - low) / span * n), F.lit(n - 1))).cast("long")

    x0, x1 = grid(box["minx"], -180.0, 360.0), grid(box["maxx"], -180.0, 360.0)
    y0, y1 = grid(box["miny"], -90.0, 180.0), grid(box["maxy"], -90.0, 180.0)
    differ = x0.bitwiseXOR(x1).bitwiseOR(y0.bitwiseXOR(y1))
    depth = F.lit(DEPTH) - F.when(differ == 0, F.lit(0)).otherwise(F.length(F.bin(differ)))

    def step(acc: Column, k: Column) -> Column:
        x, y, d, live = acc["x"], acc["y"], acc["d"], k < acc["depth"]
        bit = F.lit(DEPTH) - 1 - k
        s = F.expr("1L") * F.pow(F.lit(2.0), bit).cast("long")
        rx = F.when(x.bitwiseAND(s) != 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        ry = F.when(y.bitwiseAND(s) != 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        turn = (ry == 0) & (rx == 1)
        fx, fy = F.when(turn, n - 1 - x).otherwise(x), F.when(turn, n - 1 - y).otherwise(y)
        nx, ny = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
        nd = d * 4 + (rx * 3).bitwiseXOR(ry)
        pick = lambda a, b: F.when(live, a).otherwise(b)
        return F.struct(pick(nx, x).alias("x"), pick(ny, y).alias("y"), pick(nd, d).alias("d"), acc["depth"].alias("depth"))

    start = F.struct(x0.alias("x"), y0.alias("y"), F.lit(0).cast("long").alias("d"), depth.cast("int").alias("depth"))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(DEPTH - 1)), start, step)
    return ((end["d"] * 2 + 1) * F.pow(F.lit(4.0), F.lit(DEPTH) - end["depth"]).cast("long")).cast("long")
