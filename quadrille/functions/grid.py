"""Windows, pixel grids, the power-of-two ladder and tile covers: exact index arithmetic on the driver, plain columns in queries."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PullTooLarge

LEVELS, MOST_TILES = 31, 1 << 20


@dataclass(frozen=True)
class Bbox:
    min_x: float
    min_y: float
    max_x: float
    max_y: float

    def expand(self, by: float) -> Bbox:
        return Bbox(self.min_x - by, self.min_y - by, self.max_x + by, self.max_y + by)

    def intersects(self, o: Bbox) -> bool:
        """Open intervals: boxes that only touch don't intersect."""
        return self.min_x < o.max_x and o.min_x < self.max_x and self.min_y < o.max_y and o.min_y < self.max_y

    def overlap(self, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
        return (min_x < self.max_x) & (max_x > self.min_x) & (min_y < self.max_y) & (max_y > self.min_y)


@dataclass(frozen=True)
class Interval:
    """Half-open, in UTC epoch milliseconds."""

    start_ms: int
    end_ms: int

    def holds(self, ms: Column) -> Column:
        return (ms >= self.start_ms) & (ms < self.end_ms)


@dataclass(frozen=True)
class Window:
    bbox: Bbox
    resolution: float
    time: Interval | None = None


@dataclass(frozen=True)
class Grid:
    """Pixel (gx, gy) of level L covers [x0 + gx r, x0 + (gx+1) r) and, downward, (y0 - (gy+1) r, y0 - gy r], with r = base 2^L."""

    x0: float
    y0: float
    base: float
    chunk: int = 256

    def resolution(self, level: int) -> float:
        return self.base * 2.0 ** min(level, LEVELS)

    def level_for(self, resolution: float) -> int:
        """The coarsest level that isn't coarser than asked for."""
        return 0 if resolution <= self.base else min(LEVELS, int(math.floor(math.log2(resolution / self.base))))

    def aligned(self, box: Bbox, level: int) -> tuple[int, int, int, int]:
        """Inclusive pixel ranges (gx0, gx1, gy0, gy1) of the box widened to whole pixels, forgiving 1e-9 of a pixel."""
        return _spread(self, box, self.resolution(level))

    def tiles(self, box: Bbox, level: int, most: int = MOST_TILES) -> tuple[int, int, int, int]:
        """Inclusive tile ranges (ix0, ix1, iy0, iy1); an error over `most` tiles."""
        r = _spread(self, box, self.resolution(level) * self.chunk)
        if (n := (r[1] - r[0] + 1) * (r[3] - r[2] + 1)) > most:
            raise PullTooLarge(f"the window touches {n} tiles; at most {most} can be pulled")
        return r

    def tile_box(self, level: int, ix: int, iy: int) -> Bbox:
        size = self.resolution(level) * self.chunk
        return Bbox(self.x0 + ix * size, self.y0 - (iy + 1) * size, self.x0 + (ix + 1) * size, self.y0 - iy * size)

    def centre(self, gx: Column, gy: Column, level: int = 0) -> tuple[Column, Column]:
        r = self.resolution(level)
        return self.x0 + (gx + 0.5) * r, self.y0 - (gy + 0.5) * r

    def cell_of(self, x: Column, y: Column, level: int = 0) -> tuple[Column, Column]:
        r = self.resolution(level)
        return F.floor((x - self.x0) / r), F.floor((self.y0 - y) / r)

    def cover(self, spark, box: Bbox, level: int) -> DataFrame:
        """level, ix, iy of every tile over the box."""
        ix0, ix1, iy0, iy1 = self.tiles(box, level)
        rows = spark.range(iy0, iy1 + 1).select(F.col("id").alias("iy"))
        return rows.select(F.lit(level).alias("level"), F.explode(F.sequence(F.lit(ix0).cast("long"), F.lit(ix1).cast("long"))).alias("ix"), "iy")

    def coarser(self, by: int) -> Grid:
        return replace(self, base=self.resolution(by))


def _spread(grid: Grid, box: Bbox, size: float) -> tuple[int, int, int, int]:
    slack = 1e-9
    low = lambda v: math.floor(v / size + slack)
    high = lambda v: math.ceil(v / size - slack) - 1
    gx0, gy0 = low(box.min_x - grid.x0), low(grid.y0 - box.max_y)
    return gx0, max(gx0, high(box.max_x - grid.x0)), gy0, max(gy0, high(grid.y0 - box.min_y))


def tile_index(g: Column, chunk: int) -> Column:
    """The tile of a pixel index; floors below 0 too."""
    return F.floor(g / F.lit(chunk)).cast("long")


HALF_WORLD = 20037508.342789244


def xyz_box(z: int, x: int, y: int) -> Bbox:
    size = 2 * HALF_WORLD / 2**z
    return Bbox(-HALF_WORLD + x * size, HALF_WORLD - (y + 1) * size, -HALF_WORLD + (x + 1) * size, HALF_WORLD - y * size)


def xyz_resolution(z: int, px: int = 256) -> float:
    return 2 * HALF_WORLD / 2**z / px


def xyz_of(lon: Column, lat: Column, z: int) -> tuple[Column, Column]:
    """The web tile that holds a position."""
    n, rad = float(2**z), F.radians(lat)
    return F.floor((lon + 180) / 360 * n), F.floor((1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n)
