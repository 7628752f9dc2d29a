"""Point clouds: windows, voxel thinning, inverse-distance grids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SourceError
from ..functions.grid import Bbox, Grid


def cloud_grid(points: DataFrame, chunk: int = 256) -> Grid:
    """From the extent and the mean spacing of a cloud: one aggregation of the source."""
    x0, x1, y0, y1, n = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if not n:
        raise SourceError("the point cloud is empty")
    area = (x1 - x0) * (y1 - y0)
    return Grid(x0, y1, math.sqrt(area / n) if area > 0 else 1.0, chunk)


def in_window(points: DataFrame, box: Bbox) -> DataFrame:
    """Half-open like tiles: left and top edges are inside."""
    return points.where((F.col("x") >= box.min_x) & (F.col("x") < box.max_x) & (F.col("y") > box.min_y) & (F.col("y") <= box.max_y))


def tile_of(points: DataFrame, grid: Grid, level: int = 0) -> DataFrame:
    size = grid.resolution(level) * grid.chunk
    return points.withColumn("ix", F.floor((F.col("x") - grid.x0) / size)).withColumn("iy", F.floor((grid.y0 - F.col("y")) / size))


def voxel_thin(points: DataFrame, resolution: float) -> DataFrame:
    """The point with the least point_id of each cube of the resolution's size, anchored at 0."""
    cube = [F.floor(F.col(c) / resolution).alias(f"v{c}") for c in "xyz"]
    kept = points.groupBy(*cube).agg(F.min_by(F.struct(*points.columns), "point_id").alias("p"))
    return kept.select("p.*")


def read_points(points: DataFrame, grid: Grid, box: Bbox, level: int) -> DataFrame:
    """Points of a window; thinned above level 0."""
    out = in_window(points, box)
    return voxel_thin(out, grid.resolution(level)) if level else out


def idw(points: DataFrame, grid: Grid, power: float = 2.0, radius_px: float = 4.0, min_points: int = 1, level: int = 0) -> DataFrame:
    """z at pixel centres, weighted by 1 / distance^power over the points within the radius; a point at the centre decides alone."""
    r = grid.resolution(level)
    reach = math.ceil(radius_px)
    gx, gy = grid.cell_of(F.col("x"), F.col("y"), level)
    near = points.select("x", "y", "z", "point_id", gx.alias("px"), gy.alias("py"))
    near = near.withColumn("gx", F.explode(F.sequence(F.col("px") - reach, F.col("px") + reach))).withColumn("gy", F.explode(F.sequence(F.col("py") - reach, F.col("py") + reach)))
    cx, cy = grid.centre(F.col("gx"), F.col("gy"), level)
    met = near.withColumn("d", F.hypot(F.col("x") - cx, F.col("y") - cy)).where(F.col("d") <= radius_px * r)
    w = F.when(F.col("d") > 0, F.pow(F.col("d"), F.lit(-float(power))))
    exact = F.min_by("z", F.when(F.col("d") == 0, F.col("point_id")))
    out = met.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.coalesce(exact, F.sum(F.col("z") * w) / F.sum(w)).alias("b0"))
    return out.where(F.col("n") >= min_points).select("gx", "gy", "b0")
