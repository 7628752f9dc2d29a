"""Float tensors in the cell form: one float column a channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ComputeError
from ..functions.nodata import bands


def to_tensor(cells: DataFrame, scales: list[float], offsets: list[float]) -> DataFrame:
    """Channel i = band i as float, times its scale, plus its offset."""
    names = bands(cells.columns)
    if len(scales) != len(offsets) or len(names) != len(scales):
        raise ComputeError(f"{len(names)} bands, {len(scales)} scales, {len(offsets)} offsets")
    f = lambda v: F.lit(float(v)).cast("float")
    return cells.select("gx", "gy", *[((F.col(c).cast("float") * f(s)).cast("float") + f(o)).cast("float").alias(c) for c, s, o in zip(names, scales, offsets, strict=True)])


def to_raster(tensor: DataFrame) -> DataFrame:
    return tensor.select("gx", "gy", *[F.col(c).cast("double").alias(c) for c in bands(tensor.columns)])
