"""Live layers over a stored tile table: dirty windows spread downstream, and only their tiles are computed again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Bbox, Grid


@dataclass(frozen=True)
class Invalidation:
    node: str
    bbox: Bbox


def spread_downstream(children: dict[str, list[tuple[str, float]]], start: str, box: Bbox) -> list[Invalidation]:
    """The dirty window of each affected node in topological order. children: node -> [(child, halo in ground units)]; at a fan-in the
    windows of the parents are united."""
    dirty, order, state = {start: box}, [], {}

    def visit(node):
        if state.get(node):
            return
        state[node] = True
        for child, _ in children.get(node, []):
            visit(child)
        order.append(node)

    visit(start)
    for node in reversed(order):
        for child, halo in children.get(node, []):
            wide = dirty[node].expand(halo)
            old = dirty.get(child)
            dirty[child] = wide if old is None else Bbox(min(old.min_x, wide.min_x), min(old.min_y, wide.min_y), max(old.max_x, wide.max_x), max(old.max_y, wide.max_y))
    return [Invalidation(n, dirty[n]) for n in reversed(order)]


class TileTable:
    """A layer's cells as Parquet, partitioned by tile, so that a dirty window overwrites its own tiles and no others."""

    def __init__(self, spark: SparkSession, path: str, grid: Grid, level: int = 0):
        self.spark, self.path, self.grid, self.level = spark, path, grid, level

    def _tiled(self, cells: DataFrame) -> DataFrame:
        c = self.grid.chunk
        return cells.withColumn("ix", F.floor(F.col("gx") / c).cast("int")).withColumn("iy", F.floor(F.col("gy") / c).cast("int"))

    def store(self, cells: DataFrame) -> None:
        self._tiled(cells).repartition("ix", "iy").write.mode("overwrite").partitionBy("ix", "iy").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).where("gx is not null")

    def refresh(self, box: Bbox, compute: Callable[[Bbox], DataFrame]) -> int:
        """Computes the tiles that the dirty box overlaps again; the number of those tiles. Each gets a row without a pixel, so that a tile
        which has none any more is overwritten too."""
        ix0, ix1, iy0, iy1 = self.grid.tiles(box, self.level)
        a, b = self.grid.tile_box(self.level, ix0, iy1), self.grid.tile_box(self.level, ix1, iy0)
        fresh = self._tiled(compute(Bbox(a.min_x, a.min_y, b.max_x, b.max_y)))
        fresh = fresh.where(F.col("ix").between(ix0, ix1) & F.col("iy").between(iy0, iy1))
        marks = self.grid.cover(self.spark, box, self.level).select(F.col("ix").cast("int"), F.col("iy").cast("int"))
        fresh = fresh.unionByName(marks, allowMissingColumns=True)
        fresh.repartition("ix", "iy").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ix", "iy").parquet(self.path)
        return (ix1 - ix0 + 1) * (iy1 - iy0 + 1)


def follow(changes: DataFrame, table: TileTable, compute: Callable[[Bbox], DataFrame], checkpoint: str, told: Callable[[Bbox], None] | None = None):
    """Starts a streaming query over dirty windows (min_x, min_y, max_x, max_y): each batch's windows are united and refreshed once."""

    def batch(df: DataFrame, _: int) -> None:
        row = df.agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).first()
        if row[0] is not None:
            box = Bbox(*row)
            table.refresh(box, compute)
            if told:
                told(box)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
