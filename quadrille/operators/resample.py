"""Bilinear resampling and reprojection: each output pixel meets its four source pixels by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs
from ..functions.grid import Bbox, Grid
from ..functions.nodata import bands, finite

LEAST_WEIGHT = 1e-6


def output_cells(spark, grid: Grid, box: Bbox, level: int = 0) -> DataFrame:
    gx0, gx1, gy0, gy1 = grid.aligned(box, level)
    rows = spark.range(gy0, gy1 + 1).select(F.col("id").alias("gy"))
    return rows.select(F.explode(F.sequence(F.lit(gx0).cast("long"), F.lit(gx1).cast("long"))).alias("gx"), "gy")


def sample(cells: DataFrame, source: Grid, wanted: DataFrame, x: Column, y: Column, level: int = 0) -> DataFrame:
    """gx, gy of wanted, with the bands of cells at the source position (x, y): the weighted sum of four taps where all are finite,
    else the heaviest tap that is (ties: the later of top left, top right, bottom left, bottom right), else nodata."""
    r = source.resolution(level)
    return four_taps(cells, wanted, (x - source.x0) / r - 0.5, (source.y0 - y) / r - 0.5)


def four_taps(cells: DataFrame, wanted: DataFrame, u: Column, v: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """sample() at fractional source pixels (u, v); keys: columns of both by which rasters of one table are told apart."""
    names = bands(cells.columns)
    placed = wanted.select(*keys, "gx", "gy", u.alias("u"), v.alias("v")).withColumn("x0", F.floor("u")).withColumn("y0", F.floor("v"))
    fx, fy = F.col("u") - F.col("x0"), F.col("v") - F.col("y0")
    tap = lambda k, dx, dy, w: F.struct(F.lit(k).alias("k"), (F.col("x0") + dx).alias("sx"), (F.col("y0") + dy).alias("sy"), w.alias("w"))
    taps = F.array(tap(0, 0, 0, (1 - fx) * (1 - fy)), tap(1, 1, 0, fx * (1 - fy)), tap(2, 0, 1, (1 - fx) * fy), tap(3, 1, 1, fx * fy))
    asked = placed.select(*keys, "gx", "gy", F.explode(taps).alias("t")).select(*keys, "gx", "gy", "t.k", "t.sx", "t.sy", "t.w")
    values = cells.select(*keys, F.col("gx").alias("sx"), F.col("gy").alias("sy"), *[finite(F.col(c)).alias(c) for c in names])
    met = asked.join(values, [*keys, "sx", "sy"])

    def blend(c: str) -> Column:
        part = [F.max(F.when(F.col("k") == i, F.col("w") * F.col(c))) for i in range(4)]
        heaviest = F.max_by(c, F.when(F.col(c).isNotNull() & (F.col("w") > LEAST_WEIGHT), F.struct("w", "k")))
        return F.when(F.count(c) == 4, part[0] + part[1] + part[2] + part[3]).otherwise(heaviest).alias(c)

    return met.groupBy(*keys, "gx", "gy").agg(*[blend(c) for c in names])


def resample(cells: DataFrame, source: Grid, target: Grid, box: Bbox) -> DataFrame:
    """Onto another grid of the same CRS."""
    wanted = output_cells(cells.sparkSession, target, box)
    return sample(cells, source, wanted, *target.centre(F.col("gx"), F.col("gy")))


def reproject(cells: DataFrame, source: Grid, source_epsg: int, target: Grid, target_epsg: int, box: Bbox) -> DataFrame:
    """Onto a grid of another CRS: each output pixel's centre is taken back to the source. Only the source pixels around the window
    are read: the filter is widened by two pixels, since none passes a join by itself."""
    wanted = output_cells(cells.sparkSession, target, box)
    back = crs.transform(target_epsg, source_epsg, columns=True)
    around = crs.envelope(box, target_epsg, source_epsg).expand(2 * source.base)
    gx0, gx1, gy0, gy1 = source.aligned(around, 0)
    near = cells.where(F.col("gx").between(gx0, gx1) & F.col("gy").between(gy0, gy1))
    return sample(near, source, wanted, *back(*target.centre(F.col("gx"), F.col("gy"))))


#: Where grids of a CRS begin.
ORIGINS = {3857: (-20037508.342789244, 20037508.342789244), 4326: (-180.0, 90.0)}


def output_grid(source: Grid, source_epsg: int, target_epsg: int, probe: int = 1000) -> Grid:
    """The grid of a reprojected source: the CRS's own origin, and the ground length of one source pixel, probed some pixels in."""
    f = crs.transform(source_epsg, target_epsg)
    x, y = source.x0 + probe * source.base, source.y0 - probe * source.base
    a, b, c = f(x, y), f(x + source.base, y), f(x, y - source.base)
    length = lambda p, q: ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5
    x0, y0 = ORIGINS.get(target_epsg) or f(source.x0, source.y0)
    return Grid(x0, y0, (length(a, b) + length(a, c)) / 2, source.chunk)
