"""Cell rasters: windows, the ladder, per-pixel algebra, masks, mosaics. One row a pixel: gx, gy, b0, b1, ...; no row, or NULL, is nodata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ComputeError, InvalidGraph
from ..functions.grid import Bbox, Grid, tile_index
from ..functions.nodata import bands, finite, no_nan
from ..plans.bandmath import divide, natural_log


def over_bands(cells: DataFrame, f) -> DataFrame:
    names = bands(cells.columns)
    return cells.select(*[f(F.col(c)).alias(c) if c in names else c for c in cells.columns])


def window(cells: DataFrame, grid: Grid, box: Bbox, level: int = 0, halo: int = 0) -> DataFrame:
    """The pixels of the outward-aligned box, widened by halo pixels; tables that carry tile columns ix, iy are pruned by them too."""
    gx0, gx1, gy0, gy1 = grid.aligned(box, level)
    grid.tiles(box, level)
    gx0, gx1, gy0, gy1 = gx0 - halo, gx1 + halo, gy0 - halo, gy1 + halo
    out = cells.where(F.col("gx").between(gx0, gx1) & F.col("gy").between(gy0, gy1))
    if {"ix", "iy"} <= set(cells.columns):
        c = grid.chunk
        out = out.where(F.col("ix").between(gx0 // c, gx1 // c) & F.col("iy").between(gy0 // c, gy1 // c))
    return out


def coarsen(cells: DataFrame, level: int) -> DataFrame:
    """A ladder level: the mean of the valid base pixels of each 2^level block (always from the base)."""
    names = bands(cells.columns)
    key = [F.shiftright("gx", level).alias("gx"), F.shiftright("gy", level).alias("gy")]
    return cells.groupBy(*key).agg(*[F.avg(no_nan(F.col(c))).alias(c) for c in names])


def tile_counts(cells: DataFrame, chunk: int) -> DataFrame:
    return cells.groupBy(tile_index(F.col("gx"), chunk).alias("ix"), tile_index(F.col("gy"), chunk).alias("iy")).agg(F.count("*").alias("pixels"))


UNARY = {"abs": F.abs, "neg": lambda x: -x, "sqrt": lambda x: no_nan(F.sqrt(x)), "ln": natural_log, "exp": F.exp}
BINARY = {"add": lambda a, b: no_nan(a + b), "subtract": lambda a, b: no_nan(a - b), "multiply": lambda a, b: no_nan(a * b), "divide": divide}


def unary(cells: DataFrame, op: str) -> DataFrame:
    return over_bands(cells, UNARY[op])


def reclassify(cells: DataFrame, classes: list[tuple[float, float, float]]) -> DataFrame:
    """The class of the first range [low, high) that holds a value; nodata where none does."""

    def pick(x):
        out = F.when(F.lit(False), F.lit(0.0))
        for low, high, value in classes:
            out = out.when((x >= low) & (x < high), F.lit(float(value)))
        return out

    return over_bands(cells, pick)


def quality_mask(cells: DataFrame, band: int, valid: list[float]) -> DataFrame:
    """Keeps a pixel's bands only where the quality band is one of the valid values."""
    if band >= len(bands(cells.columns)):
        raise ComputeError(f"quality band b{band} is not in the input")
    good = F.col(f"b{band}").isin([float(v) for v in valid])
    return over_bands(cells, lambda x: F.when(good, x))


def mosaic(*inputs: DataFrame) -> DataFrame:
    """On one grid: for each pixel and band, the first input in order that has a value."""
    if len(inputs) < 2:
        raise InvalidGraph("a mosaic takes two inputs or more")
    names = bands(inputs[0].columns)
    if any(bands(x.columns) != names for x in inputs):
        raise InvalidGraph("inputs of a mosaic have different bands")
    # One shuffle for any number of inputs: the first value in wiring order wins.
    tagged = reduce(DataFrame.unionByName, [x.select("gx", "gy", *names, F.lit(i).alias("turn")) for i, x in enumerate(inputs)])
    return tagged.groupBy("gx", "gy").agg(*[F.min_by(c, F.when(no_nan(F.col(c)).isNotNull(), F.col("turn"))).alias(c) for c in names])


def combine(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Two inputs on one grid, band by band."""
    names = bands(a.columns)
    if bands(b.columns) != names:
        raise InvalidGraph("both inputs need the same bands")
    right = b.select("gx", "gy", *[F.col(c).alias(f"r_{c}") for c in names])
    return a.join(right, ["gx", "gy"]).select("gx", "gy", *[BINARY[op](F.col(c), F.col(f"r_{c}")).alias(c) for c in names])


def gray(cells: DataFrame, low: float, high: float) -> DataFrame:
    """gray 0-255 and alpha (0 where nodata) of band 0."""
    v = finite(F.col("b0"))
    span = max(high - low, 2.220446049250313e-16)
    level = F.round(F.least(F.greatest((v - low) / span, F.lit(0.0)), F.lit(1.0)) * 255).cast("long")
    return cells.select("gx", "gy", F.coalesce(level, F.lit(0)).alias("gray"), F.when(v.isNull(), 0).otherwise(255).cast("long").alias("alpha"))


def to_tiles(cells: DataFrame, chunk: int) -> DataFrame:
    """One row a tile: ix, iy, and each band's values row by row (NaN for nodata)."""
    names = bands(cells.columns)
    at = (F.pmod("gy", F.lit(chunk)) * chunk + F.pmod("gx", F.lit(chunk))).cast("int")
    grouped = cells.groupBy(tile_index(F.col("gx"), chunk).alias("ix"), tile_index(F.col("gy"), chunk).alias("iy")).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.array(*[F.col(c).cast("double") for c in names]).alias("v")))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(chunk * chunk - 1))
    plane = lambda i: F.transform(every, lambda k: F.coalesce(F.col("m")[k][i], F.lit(float("nan"))))
    return grouped.select("ix", "iy", F.array(*[plane(i) for i in range(len(names))]).alias("bands"))


def from_tiles(tiles: DataFrame, chunk: int, count: int) -> DataFrame:
    exploded = tiles.select("ix", "iy", "bands", F.posexplode(F.col("bands")[0]).alias("k", "_"))
    cells = exploded.select((F.col("ix") * chunk + F.col("k") % chunk).alias("gx"), (F.col("iy") * chunk + F.floor(F.col("k") / chunk)).alias("gy"), *[no_nan(F.col("bands")[i][F.col("k")]).alias(f"b{i}") for i in range(count)])
    return cells.where(reduce(lambda a, b: a | b, [F.col(f"b{i}").isNotNull() for i in range(count)]))
