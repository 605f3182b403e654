"""Web-Mercator tiles as cells."""

from __future__ import annotations

import math

LAT_MAX = 85.05112878
OVERSIZED = -1
Box = tuple[float, float, float, float]


def tile_of(lon: float, lat: float, zoom: int) -> tuple[int, int]:
    n = 1 << zoom
    r = math.radians(max(-LAT_MAX, min(LAT_MAX, lat)))
    x = math.floor((lon + 180) / 360 * n)
    y = math.floor((1 - math.log(math.tan(r) + 1 / math.cos(r)) / math.pi) / 2 * n)
    return max(0, min(n - 1, x)), max(0, min(n - 1, y))


def tile_cover(box: Box, zoom: int = 8, max_cells: int = 64) -> list[int] | None:
    """Ids y * 2**zoom + x of the tiles that a box touches, or None if they are too many."""
    x0, y0 = tile_of(box[0], box[3], zoom)
    x1, y1 = tile_of(box[2], box[1], zoom)
    if (x1 - x0 + 1) * (y1 - y0 + 1) > max_cells:
        return None
    return [(y << zoom) + x for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)]


def cells_for_feature(box: Box, zoom: int = 8, max_cells: int = 64) -> list[int]:
    """A feature that covers too many tiles is filed under OVERSIZED."""
    return tile_cover(box, zoom, max_cells) or [OVERSIZED]


def cells_for_query(box: Box, zoom: int = 8, max_cells: int = 64) -> list[int] | None:
    """Tiles to look up (OVERSIZED among them), or None: the table is scanned."""
    cover = tile_cover(box, zoom, max_cells)
    return None if cover is None else [*cover, OVERSIZED]


def boxes_overlap(a: Box, b: Box) -> bool:
    return a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]


def pad_box(b: Box, d: float) -> Box:
    return b[0] - d, b[1] - d, b[2] + d, b[3] + d
