"""Scene catalogs: search pages, blocks of items, the items of a window, and their cells on the anchor's grid."""

from __future__ import annotations

import json
import math
import urllib.parse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PullTooLarge, SourceError
from ..functions import crs
from ..functions.grid import Bbox, Grid, Interval
from ..functions.time import epoch_ms, format_rfc3339
from . import composite, resample

#: Items of a search, degrees of a block and blocks of a pull at most, and items of a page.
MOST_ITEMS, BLOCK, MOST_BLOCKS, PAGE = 1000, 2.0, 32, 100


def stac_datetime(spark: SparkSession, time: Interval) -> str:
    """The interval as a search's datetime, "start/end". A search takes it as closed, so an item of the very end may come back."""
    return spark.range(1).select(F.concat_ws("/", *[format_rfc3339(F.lit(ms).cast("long")) for ms in (time.start_ms, time.end_ms)])).first()[0]


def search_url(base: str, collection: str, box: Bbox, datetime: str | None = None, limit: int = PAGE) -> str:
    ask = {"collections": collection, "bbox": f"{box.min_x},{box.min_y},{box.max_x},{box.max_y}", "limit": limit} | ({"datetime": datetime} if datetime else {})
    return f"{base.rstrip('/')}/search?{urllib.parse.urlencode(ask, safe=',:/')}"


def search(spark: SparkSession, fetch: Callable[[str], bytes], url: str, most: int = MOST_ITEMS) -> DataFrame:
    """A `feature` column with the items of a search: fetch(url) gives a page, whose link `next` leads on. More items than `most` are an
    error, so what the driver holds is bounded."""
    found: list[tuple[str]] = []
    seen = set()
    while url:
        if url in seen:
            raise SourceError(f"pages of the search lead back to {url}")
        seen.add(url)
        page = json.loads(fetch(url))
        found += [(json.dumps(x),) for x in page.get("features", [])]
        if len(found) > most:
            raise PullTooLarge(f"the search has more than {most} items")
        url = next((x["href"] for x in page.get("links", []) if x.get("rel") == "next" and x.get("href")), None)
    return spark.createDataFrame(found, "feature string")


def opened(items: DataFrame) -> DataFrame:
    """The newest item, which fixes the grid, the CRS and the band counts; an error if there is none."""
    first = composite.anchor(items)
    if first.isEmpty():
        raise SourceError("the search has no usable item")
    return first


def blocks(box: Bbox, most: int = MOST_BLOCKS) -> tuple[int, int, int, int]:
    """Inclusive ranges (bx0, bx1, by0, by1) of the blocks that a lon/lat window touches."""
    bx0, bx1 = math.floor(box.min_x / BLOCK), max(math.floor(box.min_x / BLOCK), math.ceil(box.max_x / BLOCK) - 1)
    by0, by1 = math.floor(box.min_y / BLOCK), max(math.floor(box.min_y / BLOCK), math.ceil(box.max_y / BLOCK) - 1)
    if (n := (bx1 - bx0 + 1) * (by1 - by0 + 1)) > most:
        raise PullTooLarge(f"the window touches {n} search blocks; at most {most} are looked up for a pull")
    return bx0, bx1, by0, by1


def by_block(items: DataFrame) -> DataFrame:
    """Items once for each block that their box touches, with bx, by: to be stored partitioned by those."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BLOCK), F.greatest(F.floor(F.col(a) / BLOCK), F.ceil(F.col(b) / BLOCK) - 1)))
    return items.withColumn("bx", span("min_x", "max_x")).withColumn("by", span("min_y", "max_y"))


def intersecting(items: DataFrame, box: Bbox, time: Interval | None = None) -> DataFrame:
    """Items whose box overlaps a window (touching isn't enough) and whose datetime is in the interval. Tables of by_block() are read in
    the window's blocks only."""
    if {"bx", "by"} <= set(items.columns):
        bx0, bx1, by0, by1 = blocks(box)
        items = items.where(F.col("bx").between(bx0, bx1) & F.col("by").between(by0, by1)).drop("bx", "by").dropDuplicates(["item_id"])
    out = items.where(box.overlap(*[F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]))
    return out if time is None else out.where(time.holds(epoch_ms(F.col("datetime"))))


def aligned(stack: DataFrame, items: DataFrame, grid: Grid, epsg: int, box: Bbox) -> DataFrame:
    """The cells of a window of items on the anchor's grid. stack: item_id, datetime, gx, gy, bands, each on its item's own grid; items:
    item_id, epsg, x0, y0, size (of a pixel) and lon/lat boxes.

    Items of the anchor's CRS and grid are taken as they are; others are sampled at the anchor's pixel centres, within their own box.
    One pass a CRS, of which EPSG has a bounded number that can be transformed.
    """
    gx0, gx1, gy0, gy1 = grid.aligned(box, 0)
    here = (F.col("epsg") == epsg) & (F.col("x0") == grid.x0) & (F.col("y0") == grid.y0) & (F.col("size") == grid.base)
    own = stack.join(F.broadcast(items.where(here).select("item_id")), "item_id", "left_semi")
    out = own.where(F.col("gx").between(gx0, gx1) & F.col("gy").between(gy0, gy1))
    keys = ("item_id", "datetime")
    for (code,) in items.where(~here).select("epsg").distinct().orderBy("epsg").collect():
        some = items.where(~here & (F.col("epsg") == code))
        cells = stack.join(F.broadcast(some.select("item_id")), "item_id", "left_semi")
        # An item asks for the window's pixels around its own box.
        onto = crs.transform(4326, epsg, columns=True)
        (ax, ay), (bx, by) = onto(F.col("min_x"), F.col("min_y")), onto(F.col("max_x"), F.col("max_y"))
        left, right = (F.floor((F.least(ax, bx) - grid.x0) / grid.base) - 2, F.ceil((F.greatest(ax, bx) - grid.x0) / grid.base) + 2)
        top, bottom = (F.floor((grid.y0 - F.greatest(ay, by)) / grid.base) - 2, F.ceil((grid.y0 - F.least(ay, by)) / grid.base) + 2)
        whole = lambda a, b: F.when(a <= b, F.sequence(a, b))
        range_x = whole(F.greatest(left, F.lit(gx0)).cast("long"), F.least(right, F.lit(gx1)).cast("long"))
        low_y, high_y = F.greatest(top, F.lit(gy0)).cast("long").alias("low_y"), F.least(bottom, F.lit(gy1)).cast("long").alias("high_y")
        times = cells.select(*keys).distinct()
        # Columns of pixels are dealt out, so that an item's pixels don't come from one task.
        columns = some.join(times, "item_id").select(*keys, "x0", "y0", "size", F.explode(range_x).alias("gx"), low_y, high_y)
        columns = columns.repartition(int(stack.sparkSession.conf.get("spark.sql.shuffle.partitions")), "item_id", "gx")
        wanted = columns.select(*keys, "x0", "y0", "size", "gx", F.explode(whole(F.col("low_y"), F.col("high_y"))).alias("gy"))
        x, y = crs.transform(epsg, code, columns=True)(*grid.centre(F.col("gx"), F.col("gy")))
        # Cells and pixels both grow with the window: neither is broadcast, whatever the planner takes their size for.
        warped = resample.four_taps(cells.hint("merge"), wanted, (x - F.col("x0")) / F.col("size") - 0.5, (F.col("y0") - y) / F.col("size") - 0.5, keys)
        out = out.unionByName(warped)
    return out


def window(stack: DataFrame, items: DataFrame, grid: Grid, epsg: int, box: Bbox, kind: str, p: float | None = None, time: Interval | None = None) -> DataFrame:
    """The composite of a window (in the anchor's CRS) over the items that meet it."""
    met = intersecting(items, crs.envelope(box, epsg, 4326), time)
    return composite.composite(aligned(stack, met, grid, epsg, box), kind, p)
