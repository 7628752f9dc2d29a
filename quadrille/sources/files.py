"""Files as DataFrames: GeoTIFF and LAS through binaryFile, cloud-optimised GeoTIFF windows as a data source, PNG and GeoTIFF sinks."""

from __future__ import annotations

import time
import urllib.error
import urllib.request

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import SourceError
from ..functions.grid import Bbox, Grid
from ..functions.nodata import bands as band_names
from . import codecs

TRIES, FIRST_WAIT, WAIT_GROWTH = 3, 0.2, 4


def read_geotiff(spark: SparkSession, path: str, count: int) -> DataFrame:
    """Cells (path, gx, gy, b0..) of GeoTIFF files with `count` bands; nodata pixels of all bands have no row."""
    names = [f"b{i}" for i in range(count)]

    def run(batches):
        for batch in batches:
            for name, body in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                tiff = codecs.GeoTiff(bytes(body.as_buffer()))
                if tiff.bands != count:
                    raise SourceError(f"{name} has {tiff.bands} bands, {count} expected")
                h, w = tiff.shape()
                for row in range(0, h, 256):
                    block = tiff.window(0, 0, row, w, min(256, h - row))
                    gy, gx = np.nonzero(~np.isnan(block).all(axis=0))
                    cols = [pa.array(b[gy, gx], from_pandas=True) for b in block]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(gx)), pa.array(gx), pa.array(gy + row), *cols], ["path", "gx", "gy", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, gx long, gy long, " + ", ".join(f"{c} double" for c in names))


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """Points of LAS files: x, y, z, intensity, classification, and point_id (file order)."""

    def run(batches):
        for batch in batches:
            for body in batch.column("content"):
                p = codecs.read_las(bytes(body.as_buffer()))
                yield pa.RecordBatch.from_arrays([*[pa.array(v) for v in p.values()], pa.array(np.arange(len(p["x"])))], [*p, "point_id"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "x double, y double, z double, intensity int, classification tinyint, point_id long")


def _planes(table: pa.Table, names: list[str], size: int, gx0: int, gy0: int) -> np.ndarray:
    out = np.full((len(names), size, size), np.nan)
    gx, gy = table["gx"].to_numpy() - gx0, table["gy"].to_numpy() - gy0
    for i, c in enumerate(names):
        out[i, gy, gx] = table[c].to_numpy().astype(float)
    return out


def geotiff_tiles(cells: DataFrame, grid: Grid, epsg: int, level: int = 0) -> DataFrame:
    """ix, iy and the GeoTIFF of each tile of cells."""
    names, chunk, r = band_names(cells.columns), grid.chunk, grid.resolution(level)

    def run(table: pa.Table) -> pa.Table:
        ix, iy = table["ix"][0].as_py(), table["iy"][0].as_py()
        body = codecs.write_geotiff(_planes(table, names, chunk, ix * chunk, iy * chunk), grid.x0 + ix * chunk * r, grid.y0 - iy * chunk * r, r, epsg)
        return pa.table({"ix": [ix], "iy": [iy], "tiff": [body]}, schema=pa.schema([("ix", pa.int64()), ("iy", pa.int64()), ("tiff", pa.binary())]))

    placed = cells.withColumn("ix", F.floor(F.col("gx") / chunk)).withColumn("iy", F.floor(F.col("gy") / chunk))
    return placed.groupBy("ix", "iy").applyInArrow(run, "ix long, iy long, tiff binary")


def png_tiles(gray: DataFrame, chunk: int) -> DataFrame:
    """ix, iy and the PNG of each tile of gray, alpha pixels."""

    def run(table: pa.Table) -> pa.Table:
        ix, iy = table["ix"][0].as_py(), table["iy"][0].as_py()
        planes = np.nan_to_num(_planes(table, ["gray", "alpha"], chunk, ix * chunk, iy * chunk)).astype(np.uint8)
        return pa.table({"ix": [ix], "iy": [iy], "png": [codecs.png_gray(*planes)]}, schema=pa.schema([("ix", pa.int64()), ("iy", pa.int64()), ("png", pa.binary())]))

    placed = gray.withColumn("ix", F.floor(F.col("gx") / chunk)).withColumn("iy", F.floor(F.col("gy") / chunk))
    return placed.groupBy("ix", "iy").applyInArrow(run, "ix long, iy long, png binary")


def http_range(url: str):
    """read(offset, length) by byte ranges: needs 206; three tries, with growing waits, after send errors, 5xx, 429 or short bodies."""

    def read(offset: int, length: int) -> bytes:
        wait = FIRST_WAIT
        for attempt in range(TRIES):
            try:
                ask = urllib.request.Request(url, headers={"Range": f"bytes={offset}-{offset + length - 1}"})
                with urllib.request.urlopen(ask, timeout=60) as got:
                    if got.status != 206:
                        raise SourceError(f"{url} answers {got.status} to a byte range")
                    body = got.read()
                if len(body) == length:
                    return body
                error: Exception = SourceError(f"{url} sent {len(body)} bytes of {length}")
            except urllib.error.HTTPError as e:
                if e.code < 500 and e.code != 429:
                    raise SourceError(f"{url}: {e.code}") from e
                error = e
            except urllib.error.URLError as e:
                error = e
            if attempt + 1 < TRIES:
                time.sleep(wait)
                wait *= WAIT_GROWTH
        raise SourceError(f"{url}: {error}")

    return read


def opened(href: str):
    if href.startswith(("http://", "https://")):
        return codecs.GeoTiff(http_range(href))

    def read(offset: int, length: int) -> bytes:
        with open(href.removeprefix("file://"), "rb") as f:
            f.seek(offset)
            return f.read(length)

    return codecs.GeoTiff(read)


class _Tile(InputPartition):
    def __init__(self, ix: int, iy: int):
        self.ix, self.iy = ix, iy


class _CogReader(DataSourceReader):
    def __init__(self, options):
        self.href, self.count = options["path"], int(options["bands"])
        self.resolution = float(options["resolution"])
        self.chunk = int(options.get("chunk", 256))
        self.box = Bbox(*[float(v) for v in options["bbox"].split(",")])

    def partitions(self):
        tiff = opened(self.href)
        grid = Grid(tiff.x0, tiff.y0, tiff.size, self.chunk)
        ix0, ix1, iy0, iy1 = grid.tiles(self.box, grid.level_for(self.resolution))
        return [_Tile(ix, iy) for iy in range(iy0, iy1 + 1) for ix in range(ix0, ix1 + 1)]

    def read(self, tile):
        tiff = opened(self.href)
        grid = Grid(tiff.x0, tiff.y0, tiff.size, self.chunk)
        r = grid.resolution(grid.level_for(self.resolution))
        page = tiff.page_for(r)
        factor = max(1, round(r / tiff.page_size(page)))
        n = self.chunk * factor
        block = codecs.decimate(tiff.window(page, tile.ix * n, tile.iy * n, n, n), factor)
        gy, gx = np.nonzero(~np.isnan(block).all(axis=0))
        cols = [pa.array(b[gy, gx], from_pandas=True) for b in block]
        yield pa.RecordBatch.from_arrays([pa.array(gx + tile.ix * self.chunk), pa.array(gy + tile.iy * self.chunk), *cols], ["gx", "gy", *[f"b{i}" for i in range(self.count)]])


class CogSource(DataSource):
    """Cells of a window of a cloud-optimised GeoTIFF at a resolution: one partition a tile, which reads only its own byte ranges.

    Options: path (a file, or http), bands, resolution, bbox (min x, min y, max x, max y), chunk.
    """

    @classmethod
    def name(cls):
        return "cog"

    def schema(self):
        return "gx long, gy long, " + ", ".join(f"b{i} double" for i in range(int(self.options["bands"])))

    def reader(self, schema):
        return _CogReader(self.options)
