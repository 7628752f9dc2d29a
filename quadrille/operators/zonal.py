"""Zonal and window statistics: pixels meet zones by tile, and a pixel goes to the last zone in request order that covers its centre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import PullTooLarge
from ..functions.grid import Grid
from ..functions.nodata import no_nan
from ..functions.time import epoch_ms

#: Zones are a request: beyond this many zone tiles, tiles are joined by shuffle and not broadcast. Steps of a series at most.
MOST_BROADCAST, MOST_STEPS = 10_000, 64


def statistics(band: str = "b0") -> list[Column]:
    """count, sum (0 if empty), minimum, maximum, mean."""
    v = no_nan(F.col(band))
    return [F.count(v).alias("count"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean")]


def window_statistics(cells: DataFrame) -> DataFrame:
    return cells.agg(*statistics())


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd crossings of a closed ring (array of x, y); edges are half-open, y1 <= y < y2."""
    n = F.size(ring)
    edges = F.arrays_zip(F.slice(ring, 1, n - 1).alias("a"), F.slice(ring, 2, n - 1).alias("b"))

    def crosses(e):
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        straddles = (ay <= y) != (by <= y)
        at = ax + (y - ay) * (bx - ax) / F.when(by != ay, by - ay)
        return F.when(straddles & (x < at), 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda s, e: s + crosses(e)) % 2 == 1


def zone_tiles(zones: DataFrame, grid: Grid, level: int = 0) -> DataFrame:
    """Zones (ord, id, min_x..max_y, and parts where they aren't rectangles) once for each tile that they touch."""
    size = grid.resolution(level) * grid.chunk
    span = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor(b / size)))
    out = zones.withColumn("ix", span(F.col("min_x") - grid.x0, F.col("max_x") - grid.x0))
    return out.withColumn("iy", span(grid.y0 - F.col("max_y"), grid.y0 - F.col("min_y")))


def burn(cells: DataFrame, zones: DataFrame, grid: Grid, level: int = 0, broadcast: bool | None = None) -> DataFrame:
    """gx, gy, zone_id and the bands of every pixel whose centre a zone covers. zones: ord, id, min_x, min_y, max_x, max_y[, rings].

    rings: array of rings (arrays of x, y) under the even-odd rule; without it zones are rectangles, half-open like pixels. The zones of a
    tile are one row, last first, and a pixel takes the first of them that covers it, so no pixel is shuffled where tiles are broadcast.
    """
    x, y = grid.centre(F.col("gx"), F.col("gy"), level)
    placed = cells.withColumn("ix", F.floor(F.col("gx") / grid.chunk)).withColumn("iy", F.floor(F.col("gy") / grid.chunk)).withColumn("x", x).withColumn("y", y)
    tiles = zone_tiles(zones, grid, level)
    if broadcast is None:
        broadcast = tiles.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    facts = ["ord", "id", "min_x", "min_y", "max_x", "max_y", *(["rings"] if "rings" in zones.columns else [])]
    tiles = tiles.groupBy("ix", "iy").agg(F.sort_array(F.collect_list(F.struct(*facts)), asc=False).alias("zones"))

    def covers(z):
        hit = (F.col("x") >= z["min_x"]) & (F.col("x") < z["max_x"]) & (F.col("y") > z["min_y"]) & (F.col("y") <= z["max_y"])
        return hit & F.aggregate(z["rings"], F.lit(False), lambda s, r: s != inside_ring(F.col("x"), F.col("y"), r)) if "rings" in facts else hit

    joined = placed.join(F.broadcast(tiles) if broadcast else tiles, ["ix", "iy"])
    zone = F.get(F.filter("zones", covers), 0)["id"]
    return joined.select("gx", "gy", zone.alias("zone_id"), *[c for c in cells.columns if c not in ("gx", "gy", "ix", "iy")]).where("zone_id is not null")


def zonal_statistics(cells: DataFrame, zones: DataFrame, grid: Grid, level: int = 0) -> DataFrame:
    """zone_id, count, sum, minimum, maximum, mean of the zones that hold a valid pixel."""
    return burn(cells, zones, grid, level).groupBy("zone_id").agg(*statistics()).where("count > 0")


def with_empty_zones(found: DataFrame, zones: DataFrame) -> DataFrame:
    """A row for each requested zone, in request order: count 0, sum 0 and NULL else where nothing was found."""
    out = zones.select("ord", F.col("id").alias("zone_id")).join(found, "zone_id", "left")
    return out.select("ord", "zone_id", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("sum", F.lit(0.0)).alias("sum"), "minimum", "maximum", "mean").orderBy("ord")


def at_steps(stack: DataFrame, steps: DataFrame) -> DataFrame:
    """Items of a stack once for each step (ord, start_ms, end_ms) that holds them. Steps are a request of at most MOST_STEPS rows."""
    if steps.limit(MOST_STEPS + 1).count() > MOST_STEPS:
        raise PullTooLarge(f"a series takes at most {MOST_STEPS} steps")
    ms = epoch_ms(F.col("datetime"))
    bounded = steps.select(F.col("ord").alias("step"), "start_ms", "end_ms")
    return stack.join(F.broadcast(bounded), (ms >= F.col("start_ms")) & (ms < F.col("end_ms"))).drop("start_ms", "end_ms")


def window_series(stack: DataFrame, steps: DataFrame, reduce_band) -> DataFrame:
    """Statistics of each step's composite."""
    pixels = at_steps(stack, steps).groupBy("step", "gx", "gy").agg(reduce_band("b0").alias("b0"))
    return pixels.groupBy("step").agg(*statistics())


def zonal_series(stack: DataFrame, steps: DataFrame, zones: DataFrame, grid: Grid, reduce_band) -> DataFrame:
    """Statistics of each step's composite in each zone."""
    pixels = at_steps(stack, steps).groupBy("step", "gx", "gy").agg(reduce_band("b0").alias("b0"))
    place = burn(pixels.select("gx", "gy").distinct(), zones, grid).select("gx", "gy", "zone_id")
    return pixels.join(place, ["gx", "gy"]).groupBy("step", "zone_id").agg(*statistics()).where("count > 0")
