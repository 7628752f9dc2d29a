"""Temporal composites of scene stacks: item_id, datetime, gx, gy, b0, ... become one value a pixel and band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ComputeError, InvalidGraph
from ..functions.grid import Interval
from ..functions.nodata import bands, finite, no_nan
from ..functions.time import epoch_ms


def reducer(kind: str, p: float | None = None):
    """The aggregate of a band column. `latest` takes the newest item's value (ties: the last item_id); the others skip non-finite values."""
    simple = {"mean": F.avg, "min": F.min, "max": F.max, "median": lambda x: F.percentile(x, 0.5), "stddev": F.stddev_pop, "count": lambda x: F.nullif(F.count(x), F.lit(0)).cast("double")}
    if kind == "latest":
        return lambda c: F.max_by(no_nan(F.col(c)), F.when(no_nan(F.col(c)).isNotNull(), F.struct("datetime", "item_id")))
    if kind == "percentile":
        if p is None:
            raise ComputeError("a percentile needs its p")
        return lambda c: F.percentile(finite(F.col(c)), min(100.0, max(0.0, p)) / 100)
    if kind not in simple:
        raise ComputeError(f"unknown composite {kind!r}")
    return lambda c: simple[kind](finite(F.col(c)))


def during(stack: DataFrame, time: Interval | None) -> DataFrame:
    return stack if time is None else stack.where(time.holds(epoch_ms(F.col("datetime"))))


def composite(stack: DataFrame, kind: str, p: float | None = None, time: Interval | None = None) -> DataFrame:
    f = reducer(kind, p)
    return during(stack, time).groupBy("gx", "gy").agg(*[f(c).alias(c) for c in bands(stack.columns)])


def dense(cells: DataFrame, gx: tuple[int, int], gy: tuple[int, int]) -> DataFrame:
    """Every pixel of the inclusive ranges, with NULL bands where cells has none."""
    spark = cells.sparkSession
    rows = spark.range(gy[0], gy[1] + 1).select(F.col("id").alias("gy"))
    every = rows.select(F.explode(F.sequence(F.lit(gx[0]).cast("long"), F.lit(gx[1]).cast("long"))).alias("gx"), "gy")
    return every.join(cells, ["gx", "gy"], "left")


def parse_items(features: DataFrame, assets: list[str]) -> DataFrame:
    """Catalog items of a `feature` JSON column: item_id, datetime, the box, epsg (0 if unstated), hrefs and band counts of the assets.

    Items without one of the assets, or without four numbers of a box, are left out.
    """
    get = lambda path: F.get_json_object("feature", path)
    box = F.from_json(get("$.bbox"), "array<double>")
    asset = [get(f"$.assets.{a}.href") for a in assets]
    of_asset = [get(f"$.assets.{a}.proj:epsg").cast("int") for a in assets]
    count = [F.coalesce(F.json_array_length(get(f"$.assets.{a}['raster:bands']")), F.json_array_length(get(f"$.assets.{a}['eo:bands']"))) for a in assets]
    out = features.select(
        get("$.id").alias("item_id"), get("$.properties.datetime").alias("datetime"), box[0].alias("min_x"), box[1].alias("min_y"), box[2].alias("max_x"), box[3].alias("max_y"),
        F.coalesce(get("$.properties['proj:epsg']").cast("int"), *of_asset, F.lit(0)).alias("epsg"), F.array(*asset).alias("hrefs"), F.array(*count).alias("counts"), F.size(box).alias("n"),
    )
    return out.where((F.col("n") >= 4) & ~F.exists("hrefs", lambda h: h.isNull())).drop("n")


def newest_first(items: DataFrame) -> DataFrame:
    return items.orderBy(F.desc("datetime"), "item_id")


def anchor(items: DataFrame) -> DataFrame:
    """The newest item, which fixes grid and CRS."""
    return newest_first(items).limit(1)


def usable(items: DataFrame, counts: list[int] | None = None) -> DataFrame:
    """Items that state a CRS and the anchor's band counts; of those with one first href the newest (ties: the least item_id)."""
    out = items.where("epsg <> 0")
    if counts is not None:
        want = F.array(*[F.lit(c) for c in counts])
        out = out.where(F.forall(F.arrays_zip("counts", want.alias("want")), lambda x: x["counts"].isNull() | (x["counts"] == x["want"])))
    newest = Window.partitionBy(F.col("hrefs")[0]).orderBy(F.desc("datetime"), "item_id")
    return out.withColumn("turn", F.row_number().over(newest)).where("turn = 1").drop("turn")


def stack_assets(parts: list[DataFrame]) -> DataFrame:
    """Cells of several assets of items (item_id, datetime, gx, gy, bands), side by side in asset order."""
    if not parts:
        raise InvalidGraph("a scene needs an asset")
    out, n = None, 0
    for part in parts:
        names = bands(part.columns)
        part = part.select("item_id", "datetime", "gx", "gy", *[F.col(c).alias(f"b{n + i}") for i, c in enumerate(names)])
        n += len(names)
        out = part if out is None else out.join(part, ["item_id", "datetime", "gx", "gy"], "full")
    return out


def s3_to_https(href: Column) -> Column:
    return F.regexp_replace(href, r"^s3://([^/]+)/", "https://$1.s3.amazonaws.com/")
