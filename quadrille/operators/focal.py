"""Neighbourhood operators, as RANGE frames on pixel indices, so missing pixels drop out of a frame.

Rows and columns are cut into blocks whose halo pixels are repeated, so one task never holds a whole raster row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nodata import bands, no_nan

BLOCK = 2048


def _pass(cells: DataFrame, along: str, across: str, r: int, block: int, make) -> DataFrame:
    """Applies make(frame) -> columns over 2r+1 pixels along an axis."""
    own = F.floor(F.col(along) / block)
    spread = F.array_distinct(F.array(own, F.floor((F.col(along) - r) / block), F.floor((F.col(along) + r) / block)))
    placed = cells.withColumn("own", own).withColumn("block", F.explode(spread))
    frame = Window.partitionBy(across, "block").orderBy(along).rangeBetween(-r, r)
    return placed.select("gx", "gy", "own", "block", *make(frame)).where("own = block").drop("own", "block")


def focal(cells: DataFrame, kind: str, r: int, block: int = BLOCK) -> DataFrame:
    """mean, min, max or median of the square of 2r+1 pixels, of the pixels that have a value; nodata centres stay nodata."""
    names = bands(cells.columns)
    clean = cells.select("gx", "gy", *[no_nan(F.col(c)).alias(c) for c in names])
    if kind == "mean":
        rows = _pass(clean, "gx", "gy", r, block, lambda w: [*names, *[F.sum(c).over(w).alias(f"s_{c}") for c in names], *[F.count(c).over(w).alias(f"n_{c}") for c in names]])
        return _pass(rows, "gy", "gx", r, block, lambda w: [F.when(F.col(c).isNotNull(), F.sum(f"s_{c}").over(w) / F.sum(f"n_{c}").over(w)).alias(c) for c in names])
    if kind in ("min", "max"):
        f = {"min": F.min, "max": F.max}[kind]
        rows = _pass(clean, "gx", "gy", r, block, lambda w: [*names, *[f(c).over(w).alias(f"s_{c}") for c in names]])
        return _pass(rows, "gy", "gx", r, block, lambda w: [F.when(F.col(c).isNotNull(), f(f"s_{c}").over(w)).alias(c) for c in names])
    if kind != "median":
        raise ValueError(f"unknown statistic {kind}")
    rows = _pass(clean, "gx", "gy", r, block, lambda w: [*names, *[F.collect_list(c).over(w).alias(f"s_{c}") for c in names]])

    def middle(c: str, w) -> Column:
        v = F.array_sort(F.flatten(F.collect_list(f"s_{c}").over(w)))
        n = F.size(v)
        return F.when(F.col(c).isNotNull(), (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2).alias(c)

    return _pass(rows, "gy", "gx", r, block, lambda w: [middle(c, w) for c in names])


def neighbours(cells: DataFrame, band: str, block: int = BLOCK) -> DataFrame:
    """gx, gy and the 3 x 3 values around each pixel, n00 (top left) to n22; NULL where a neighbour is missing."""
    step = lambda w, axis, c, d: F.max(c).over(w.rangeBetween(d, d))
    clean = cells.select("gx", "gy", no_nan(F.col(band)).alias("v"))
    rows = _pass(clean, "gx", "gy", 1, block, lambda w: [step(w, "gx", "v", d).alias(f"r{d + 1}") for d in (-1, 0, 1)])
    return _pass(rows, "gy", "gx", 1, block, lambda w: [step(w, "gy", f"r{j}", d).alias(f"n{d + 1}{j}") for d in (-1, 0, 1) for j in range(3)])


def gradients(cells: DataFrame, size: float, block: int = BLOCK) -> DataFrame:
    """Horn's gradients: rise to the east and to the north, NULL where one of the nine values is missing."""
    n = {k: F.col(f"n{k}") for k in ("00", "01", "02", "10", "11", "12", "20", "21", "22")}
    full = n["11"].isNotNull()
    east = ((n["02"] + 2 * n["12"] + n["22"]) - (n["00"] + 2 * n["10"] + n["20"])) / (8 * size)
    north = ((n["00"] + 2 * n["01"] + n["02"]) - (n["20"] + 2 * n["21"] + n["22"])) / (8 * size)
    both = F.when(full & (east + north).isNotNull(), F.lit(True))
    return neighbours(cells, "b0", block).select("gx", "gy", F.when(both, east).alias("east"), F.when(both, north).alias("north"))


def slope(cells: DataFrame, size: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Degrees from the horizontal."""
    return gradients(cells, size, block).select("gx", "gy", F.degrees(F.atan(F.hypot("east", "north"))).alias("b0"))


def aspect(cells: DataFrame, size: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Compass degrees downslope, north 0 and clockwise; nodata where it is flat."""
    turn = F.pmod(F.degrees(F.atan2(-F.col("east"), -F.col("north"))) + 360.0, F.lit(360.0))
    return gradients(cells, size, block).select("gx", "gy", F.when((F.col("east") != 0) | (F.col("north") != 0), turn).alias("b0"))


def hillshade(cells: DataFrame, size: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0, block: int = BLOCK) -> DataFrame:
    """0 to 255 by the angle between the surface and the light."""
    zenith, az = math.radians(90 - altitude), math.radians(azimuth)
    e, n = F.col("east"), F.col("north")
    # The surface normal is (-east, -north, 1) over its length; the light comes from the azimuth at the altitude.
    shade = (math.cos(zenith) - (e * math.sin(az) + n * math.cos(az)) * math.sin(zenith)) / F.sqrt(e * e + n * n + 1)
    return gradients(cells, size, block).select("gx", "gy", F.when(shade.isNotNull(), F.greatest(shade, F.lit(0.0)) * 255).alias("b0"))


def convolve(cells: DataFrame, kernel: list[float], block: int = BLOCK) -> DataFrame:
    """3 x 3 cross-correlation of float bands, kernel rows from the top; missing taps add 0, missing centres stay so."""
    out = None
    for c in bands(cells.columns):
        near = neighbours(cells, c, block)
        total = F.lit(0.0).cast("float")
        for i in range(9):
            tap = F.coalesce(F.col(f"n{i // 3}{i % 3}").cast("float"), F.lit(0.0).cast("float"))
            total = (total + (tap * F.lit(kernel[i]).cast("float")).cast("float")).cast("float")
        band = near.select("gx", "gy", F.when(F.col("n11").isNotNull(), total).alias(c))
        out = band if out is None else out.join(band, ["gx", "gy"])
    return out
