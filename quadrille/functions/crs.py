"""Coordinate systems: EPSG 4326, 3857 (spherical Mercator) and WGS 84 / UTM (Krueger series), for numbers and for columns alike."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..errors import ProjectionError

RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
_N = FLATTENING / (2 - FLATTENING)
_A = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_SCALE, _FALSE_EAST, _FALSE_NORTH = 0.9996, 500_000.0, 10_000_000.0


def _to_lonlat(epsg: int, m):
    if epsg == 4326:
        return lambda x, y: (x, y)
    if epsg == 3857:
        return lambda x, y: (x * (180 / math.pi / RADIUS), (m.atan(m.exp(y * (1 / RADIUS))) * 2 - math.pi / 2) * (180 / math.pi))
    zone, south = _utm(epsg)

    def inverse(x, y):
        xi, eta = (y - south) * (1 / _SCALE / _A), (x - _FALSE_EAST) * (1 / _SCALE / _A)
        a, b = xi, eta
        for j, c in enumerate(_BETA, 1):
            a, b = a - m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * c, b - m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * c
        chi = m.asin(m.sin(a) / m.cosh(b))
        lat = chi
        for j, c in enumerate(_DELTA, 1):
            lat = lat + m.sin(chi * (2 * j)) * c
        return m.atan2(m.sinh(b), m.cos(a)) * (180 / math.pi) + zone, lat * (180 / math.pi)

    return inverse


def _from_lonlat(epsg: int, m):
    if epsg == 4326:
        return lambda x, y: (x, y)
    if epsg == 3857:
        return lambda x, y: (x * (math.pi / 180 * RADIUS), m.log(m.tan(y * (math.pi / 360) + math.pi / 4)) * RADIUS)
    zone, south = _utm(epsg)
    e = 2 * math.sqrt(_N) / (1 + _N)

    def forward(x, y):
        lat, lon = y * (math.pi / 180), (x - zone) * (math.pi / 180)
        t = m.sinh(m.atanh(m.sin(lat)) - m.atanh(m.sin(lat) * e) * e)
        xi, eta = m.atan2(t, m.cos(lon)), m.asinh(m.sin(lon) / m.sqrt(t * t + m.cos(lon) * m.cos(lon)))
        east, north = eta, xi
        for j, c in enumerate(_ALPHA, 1):
            east, north = east + m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * c, north + m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * c
        return east * (_SCALE * _A) + _FALSE_EAST, north * (_SCALE * _A) + south

    return forward


def _utm(epsg: int) -> tuple[float, float]:
    """Central meridian and false northing of 326zz (north) and 327zz (south)."""
    half, zone = divmod(epsg, 100)
    if half not in (326, 327) or not 1 <= zone <= 60:
        raise ProjectionError(f"no transform for EPSG:{epsg}")
    return zone * 6.0 - 183.0, _FALSE_NORTH if half == 327 else 0.0


def transform(source: int, target: int, columns: bool = False):
    """A function (x, y) -> (x, y) between two EPSG codes, of numbers or of columns."""
    m = F if columns else math
    if source == target:
        return lambda x, y: (x, y)
    back, on = _to_lonlat(source, m), _from_lonlat(target, m)
    return lambda x, y: on(*back(x, y))


def envelope(box, source: int, target: int, segments: int = 16):
    """The bounding box of a box's edges, each cut into segments, in another CRS."""
    from .grid import Bbox

    f, steps = transform(source, target), [i / segments for i in range(segments + 1)]
    xs = [box.min_x + (box.max_x - box.min_x) * s for s in steps]
    ys = [box.min_y + (box.max_y - box.min_y) * s for s in steps]
    points = [f(x, y) for x in xs for y in (box.min_y, box.max_y)] + [f(x, y) for y in ys for x in (box.min_x, box.max_x)]
    return Bbox(min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points))


def authority(epsg: int) -> str:
    return f"EPSG:{epsg}"
