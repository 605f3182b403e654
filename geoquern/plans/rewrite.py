"""What a spatial predicate against a constant implies for boxes and cells, and constant folding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import codec
from ..core import model as M
from ..functions import FUNCTIONS, native
from ..functions.register import call
from ..index import quadtree

#: Predicates that hold only where the boxes overlap.
OVERLAPPING = ("ST_Intersects", "ST_Contains", "ST_Within", "ST_Covers", "ST_CoveredBy", "ST_Touches", "ST_Crosses", "ST_Overlaps", "ST_ContainsProperly")


def fold(name: str, *args) -> bytes | str | float | int | bool | None:
    """A function of constants, computed once on the driver."""
    return FUNCTIONS[name].call(*args)


def implied_box(predicate: str, constant: bytes, distance: float = 0.0) -> tuple[float, float, float, float] | None:
    """The box that a geometry must meet for the predicate to hold against the constant; None if nothing follows."""
    if predicate not in (*OVERLAPPING, "ST_DWithin"):
        return None
    box = M.envelope(codec.decode(constant))
    if box is None:
        return None
    return (box[0] - distance, box[1] - distance, box[2] + distance, box[3] + distance)


def implied_filter(predicate: str, constant: bytes, box: Column, cell: Column | None = None, distance: float = 0.0) -> Column:
    """Comparisons on box and cell columns that every match satisfies (they reach the Parquet scan)."""
    b = implied_box(predicate, constant, distance)
    if b is None:
        return F.lit(True)
    out = native.boxes_overlap(box, b)
    return out if cell is None else quadtree.cell_filter(b, cell) & out


def refine(predicate: str, geom: Column, constant: bytes, distance: float | None = None) -> Column:
    """The exact predicate; the constant is decoded once per worker."""
    more = () if distance is None else (F.lit(float(distance)),)
    return call(predicate, geom, F.lit(constant), *more)
