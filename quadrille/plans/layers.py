"""Layer files (TOML): named pipelines of a source, operators and a gray range, each ending in web-mercator tiles."""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ComputeError, PullTooLarge
from ..functions import crs
from ..functions.grid import HALF_WORLD, Bbox, Grid, Window, xyz_box, xyz_resolution
from ..functions.time import epoch_ms
from ..operators import focal, raster, resample
from ..sources import files
from .bandmath import band_math
from .graph import Graph, Reproject, Source, Transform

#: The gray range that an operator implies.
RANGES = {"slope": (0.0, 90.0), "aspect": (0.0, 360.0)}
FIELDS = {"stac": {"type", "collection", "assets", "search", "composite", "percentile", "bbox"}, "cog": {"type", "href", "bands"}}
OPS = {"hillshade": {"type", "azimuth", "altitude"}, "bandmath": {"type", "expression", "min", "max"}, "slope": {"type"}, "aspect": {"type"}}
MOST_TILES = 4096
COMPOSITES = ("latest", "mean", "min", "max", "median", "percentile", "stddev", "count")


@dataclass
class LayerSpec:
    name: str
    source: dict
    ops: list[dict] = field(default_factory=list)

    @property
    def gray(self) -> tuple[float, float]:
        """The last operator that sets a range wins; a hillshade sets none."""
        out = (0.0, 255.0)
        for op in self.ops:
            out = (op["min"], op["max"]) if op["type"] == "bandmath" else RANGES.get(op["type"], out)
        return out


def parse_layers(text: str) -> list[LayerSpec]:
    """Layers of a TOML text; unknown fields, repeated or malformed names and empty files are errors."""
    body = tomllib.loads(text)
    if set(body) - {"layer"} or not body.get("layer"):
        raise ComputeError("a layer file holds one or more [[layer]] and nothing else")
    out: list[LayerSpec] = []
    for x in body["layer"]:
        if set(x) - {"name", "source", "op"}:
            raise ComputeError(f"unknown fields {sorted(set(x) - {'name', 'source', 'op'})}")
        name, source, ops = x.get("name", ""), x.get("source", {}), x.get("op", [])
        if not name or "/" in name or " " in name or any(o.name == name for o in out):
            raise ComputeError(f"layer name {name!r} is empty, repeated or holds a slash or space")
        for part, known in [(source, FIELDS), *((o, OPS) for o in ops)]:
            if part.get("type") not in known or set(part) - known[part["type"]]:
                raise ComputeError(f"layer {name}: unknown type or fields in {part}")
        if source["type"] == "stac" and not source.get("assets"):
            raise ComputeError(f"layer {name}: a catalog source needs assets")
        if source.get("composite", "latest") not in COMPOSITES:
            raise ComputeError(f"layer {name}: unknown composite {source['composite']!r}")
        for op in ops:
            if op["type"] == "bandmath" and not {"expression", "min", "max"} <= set(op):
                raise ComputeError(f"layer {name}: band math needs expression, min and max")
        out.append(LayerSpec(name, source, ops))
    return out


def operator(op: dict) -> Transform:
    kind = op["type"]
    if kind == "bandmath":
        return Transform(lambda c, g: band_math(c, op["expression"]))
    if kind == "hillshade":
        return Transform(lambda c, g: focal.hillshade(c, g.base, op.get("azimuth", 315.0), op.get("altitude", 45.0)), halo=1)
    return Transform(lambda c, g: {"slope": focal.slope, "aspect": focal.aspect}[kind](c, g.base), halo=1)


def build(spec: LayerSpec, source: Source) -> tuple[Graph, int]:
    """The graph of a layer over an opened source, ending on EPSG 3857, and its last node."""
    graph = Graph()
    last = graph.add(source)
    for op in spec.ops:
        last = graph.add(operator(op), last)
    return graph, graph.add(Reproject(3857), last)


def render_tile(spec: LayerSpec, source: Source, z: int, x: int, y: int, time=None) -> DataFrame:
    """gray and alpha of the 256 x 256 pixels (gx, gy from 0) of a web tile."""
    if not 0 <= z <= 24 or not (0 <= x < 2**z and 0 <= y < 2**z):
        raise ComputeError(f"no tile {z}/{x}/{y}")
    graph, last = build(spec, source)
    engine, box = graph.build(), xyz_box(z, x, y)
    r = xyz_resolution(z)
    grid = engine.grid(last)
    level = grid.level_for(r)
    around = box.expand(2 * grid.resolution(level))
    pulled = engine.pull(last, Window(around, r, time))
    out = Grid(box.min_x, box.max_y, r)
    cells = resample.resample(pulled, grid.coarser(level), out, box)
    every = resample.output_cells(pulled.sparkSession, out, box).join(cells, ["gx", "gy"], "left")
    return raster.gray(every.where((F.col("gx") < 256) & (F.col("gy") < 256)), *spec.gray)


def materialize(engine, node: int, extent, max_level: int, path: str, time=None) -> int:
    """Writes levels 0 to max_level of a node over an extent, partitioned by level and tile; the number of tiles of the covers. A level
    that is there already is replaced whole."""
    grid, total = engine.grid(node), 0
    for level in range(max_level + 1):
        ix0, ix1, iy0, iy1 = grid.tiles(extent, level)
        total += (ix1 - ix0 + 1) * (iy1 - iy0 + 1)
        cells = engine.pull(node, Window(extent, grid.resolution(level), time))
        tiled = cells.withColumn("ix", F.floor(F.col("gx") / grid.chunk)).withColumn("iy", F.floor(F.col("gy") / grid.chunk))
        tiled.repartition("ix", "iy").write.mode("overwrite").partitionBy("ix", "iy").parquet(f"{path}/level={level}")
    return total


def render_tiles(spec: LayerSpec, source: Source, z: int, tiles: list[tuple[int, int]], time=None) -> DataFrame:
    """x, y, gx, gy, gray and alpha of many web tiles of one zoom: pixels (gx, gy from 0 in each tile). One plan serves the whole list."""
    if not 0 <= z <= 24 or not tiles or any(not (0 <= x < 2**z and 0 <= y < 2**z) for x, y in tiles):
        raise ComputeError(f"no such tiles at zoom {z}")
    if len(tiles) > MOST_TILES:
        raise PullTooLarge(f"at most {MOST_TILES} tiles in a call")
    graph, last = build(spec, source)
    engine, r = graph.build(), xyz_resolution(z)
    boxes = [xyz_box(z, x, y) for x, y in tiles]
    box = Bbox(min(b.min_x for b in boxes), min(b.min_y for b in boxes), max(b.max_x for b in boxes), max(b.max_y for b in boxes))
    grid = engine.grid(last)
    level = grid.level_for(r)
    pulled = engine.pull(last, Window(box.expand(2 * grid.resolution(level)), r, time))
    spark = pulled.sparkSession
    out = Grid(-HALF_WORLD, HALF_WORLD, r)
    asked = spark.createDataFrame(sorted(set(tiles)), "x long, y long")
    side = F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))
    every = asked.withColumn("px", F.explode(side)).withColumn("py", F.explode(side)).select("x", "y", "px", "py", (F.col("x") * 256 + F.col("px")).alias("gx"), (F.col("y") * 256 + F.col("py")).alias("gy"))
    sampled = resample.sample(pulled, grid.coarser(level), every, *out.centre(F.col("gx"), F.col("gy")))
    placed = every.join(sampled, ["gx", "gy"], "left")
    shade = raster.gray(placed, *spec.gray)
    return shade.select(F.floor(F.col("gx") / 256).alias("x"), F.floor(F.col("gy") / 256).alias("y"), F.pmod("gx", F.lit(256)).alias("gx"), F.pmod("gy", F.lit(256)).alias("gy"), "gray", "alpha")


def pyramid(spec: LayerSpec, source: Source, lonlat: Bbox, max_zoom: int, path: str, time=None) -> int:
    """PNG tiles (x, y, png) of every zoom 0 to max_zoom over a lon/lat extent, under path/z=...; the number of tiles."""
    total, reach = 0, crs.envelope(lonlat, 4326, 3857)
    for z in range(max_zoom + 1):
        size = 2 * HALF_WORLD / 2**z
        x0, x1 = (min(2**z - 1, max(0, math.floor((v + HALF_WORLD) / size))) for v in (reach.min_x, reach.max_x))
        y0, y1 = (min(2**z - 1, max(0, math.floor((HALF_WORLD - v) / size))) for v in (reach.max_y, reach.min_y))
        tiles = [(x, y) for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)]
        total += len(tiles)
        cells = render_tiles(spec, source, z, tiles, time).select((F.col("x") * 256 + F.col("gx")).alias("gx"), (F.col("y") * 256 + F.col("gy")).alias("gy"), "gray", "alpha")
        files.png_tiles(cells, 256).select(F.col("ix").alias("x"), F.col("iy").alias("y"), "png").write.mode("overwrite").parquet(f"{path}/z={z}")
    return total


def listing(spark, specs: list[LayerSpec], sources: dict[str, Source]) -> DataFrame:
    """name, kind, gray range and, for sources that vary in time, the first and last instant of each layer."""
    rows = []
    for spec in specs:
        source = sources.get(spec.name)
        span = source.cells.agg(F.min(epoch_ms(F.col("datetime"))), F.max(epoch_ms(F.col("datetime")))).first() if source and source.time_varying else (None, None)
        rows.append((spec.name, spec.source["type"], *map(float, spec.gray), *span))
    return spark.createDataFrame(rows, "name string, source string, low double, high double, first_ms long, last_ms long")
