"""A geometry decoded once and tested against many."""

from __future__ import annotations

from ..core import codec
from ..core.model import Geom
from . import FUNCTIONS
from .registry import encode_result


class Prepared:
    """A decoded geometry with the predicates, measures and encodings that a filter over many candidates uses.

    In a DataFrame the same holds by itself: a constant argument is decoded once per worker."""

    def __init__(self, geom: Geom):
        self.geom = geom

    @classmethod
    def from_blob(cls, value: bytes) -> Prepared:
        return cls(codec.decode(value))

    @classmethod
    def from_text(cls, text: str, srid: int = 0) -> Prepared:
        return cls(codec.parse_wkt(text, srid))

    def _with(self, name: str, other: bytes | Prepared, *more):
        return FUNCTIONS[name].kernel(self.geom, other.geom if isinstance(other, Prepared) else codec.decode(other), *more)

    def intersects(self, other) -> bool:
        return self._with("ST_Intersects", other)

    def contains(self, other) -> bool:
        return self._with("ST_Contains", other)

    def within(self, other) -> bool:
        return self._with("ST_Within", other)

    def covers(self, other) -> bool:
        return self._with("ST_Covers", other)

    def distance(self, other) -> float | None:
        return self._with("ST_Distance", other)

    def dwithin(self, other, d: float) -> bool:
        return self._with("ST_DWithin", other, d)

    def as_geojson(self, digits: int = 9) -> str:
        return FUNCTIONS["ST_AsGeoJSON"].kernel(self.geom, digits)

    def as_text(self) -> str:
        return codec.wkt(self.geom)

    def as_binary(self) -> bytes:
        return FUNCTIONS["ST_AsBinary"].kernel(self.geom)

    def as_gpb(self) -> bytes:
        return codec.storage(codec.encode(self.geom))

    @property
    def srid(self) -> int:
        return self.geom.srid

    def transform(self, srid: int) -> Prepared:
        return Prepared(codec.decode(encode_result(FUNCTIONS["ST_Transform"].kernel(self.geom, srid))))
