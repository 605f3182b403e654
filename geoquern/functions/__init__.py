"""The ``ST_`` function catalogue."""

from . import areal, basic, cells, formats, geodesic, io, solid  # noqa: F401
from .registry import FUNCTIONS, Function, fn

__all__ = ["FUNCTIONS", "Function", "fn"]
