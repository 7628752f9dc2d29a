"""The registered queries: each operator over rasters, stacks, clouds and features that are derived from the relational test tables."""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs
from ..functions.grid import Bbox, Grid, Interval, tile_index
from ..operators import catalog, composite, focal, points, raster, resample, tensor, vector, zonal
from ..sources import codecs, files
from .bandmath import band_math

SHAPE = Grid(0.0, 0.0, 1.0, 16)
GEO = Grid(7.0, 47.0, 0.01, 16)
MERCATOR = Grid(-20037508.342789244, 20037508.342789244, 1500.0, 16)
#: ord, id, min_x, min_y, max_x, max_y; y falls, so rows 0..9 are y 0..-10. 42 lies over a part of 7, and 99 beyond the data.
ZONES = [(0, 3, 2.0, -8.0, 12.0, -1.0), (1, 7, 10.0, -18.0, 30.0, -4.0), (2, 42, 20.0, -15.0, 41.0, -10.0), (3, 5, 0.0, -20.0, 50.0, -19.0), (4, 99, 100.0, -120.0, 110.0, -110.0)]
STEPS = [(i, 1704067200000 + i * 7 * 86400000, 1704067200000 + (i + 1) * 7 * 86400000) for i in range(5)]
INTERVAL = (852076800000, 883612800000)  # 1997


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dem(spark, d):
    p = table(spark, d, "part")
    return p.select((F.col("p_partkey") % 50).alias("gx"), F.floor(F.col("p_partkey") / 50).alias("gy"), F.col("p_retailprice").alias("b0"), F.col("p_size").cast("double").alias("b1"))


def holed(spark, d):
    """dem without values where the size is a multiple of 7."""
    c = dem(spark, d)
    return c.select("gx", "gy", F.when(F.col("b1") % 7 != 0, F.col("b0")).alias("b0"), "b1")


def grid2(spark, d):
    o = table(spark, d, "orders")
    return o.select((F.col("o_orderkey") % 125).alias("gx"), F.floor(F.col("o_orderkey") / 125).alias("gy"), F.col("o_totalprice").alias("b0"))


def exact(spark, d):
    return dem(spark, d).select("gx", "gy", (F.col("gx") + 1000 * F.col("gy")).cast("double").alias("b0"))


def stack(spark, d):
    li = table(spark, d, "lineitem")
    month = F.date_format("l_shipdate", "yyyy-MM")
    return li.groupBy(month.alias("item_id"), (F.col("l_partkey") % 50).alias("gx"), (F.col("l_suppkey") % 40).alias("gy")).agg(
        F.max("l_quantity").cast("double").alias("b0"), F.max(F.round(F.col("l_discount") * 100)).cast("double").alias("b1")).withColumn("datetime", F.to_timestamp(F.concat("item_id", F.lit("-01")), "yyyy-MM-dd"))


def cloud(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").cast("double").alias("x"), F.col("value").cast("double").alias("y"), (F.col("event_id") % 97).cast("double").alias("z"), F.col("event_id").alias("point_id"), "ts")


def event_stack(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").cast("string").alias("item_id"), F.col("ts").alias("datetime"), (F.col("user_id") % 40).alias("gx"), (F.col("event_id") % 20).alias("gy"), F.floor("value").cast("double").alias("b0"))


def zones(spark, rows=ZONES):
    return spark.createDataFrame(rows, "ord int, id long, min_x double, min_y double, max_x double, max_y double")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else c for c, t in df.dtypes])


def rectangles(spark, d) -> DataFrame:
    """A feature a supplier: a small rectangle, with a property v where its key isn't a multiple of 5."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    x, y = (k * 7 % 90).cast("double"), -(k * 11 % 60).cast("double")
    corner = lambda dx, dy: F.array(x + dx, y - dy)
    ring = F.array(corner(0, 0), corner(6, 0), corner(6, 4), corner(0, 4), corner(0, 0))
    geometry = F.concat(F.lit('["Polygon",[['), F.to_json(ring), F.lit("]]]"))
    props = F.when(k % 5 != 0, F.create_map(F.lit("v"), (k % 13).cast("string"))).otherwise(F.expr("map_from_arrays(array('w'), array('1'))"))
    return s.select(k.cast("long").alias("id"), geometry.alias("geometry"), props.alias("properties"))


def event_features(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.lit('["Point",[[[[0,0]]]]]').alias("geometry"), F.from_json("props", "map<string, string>").alias("properties"))


def entry_zonal_index(spark, d):
    index = band_math(composite.composite(stack(spark, d), "median"), "(b0 - b1) / (b0 + b1)")
    return rounded(zonal.zonal_statistics(index, zones(spark), SHAPE))


def _box(gx0, gx1, gy0, gy1):
    return Bbox(gx0, -gy1, gx1, -gy0)


def catalog_anchor(spark, d):
    items = stack(spark, d).groupBy("item_id").agg(F.first("datetime").alias("t"), F.count("*").alias("pixels"))
    return composite.anchor(items.select("item_id", F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), "pixels"))


def composite_query(kind, p=None):
    return lambda spark, d: rounded(composite.composite(stack(spark, d), kind, p))


def mosaic_first_wins(spark, d):
    return raster.mosaic(holed(spark, d).select("gx", "gy", "b0"), grid2(spark, d))


def combine_sub(spark, d):
    return rounded(raster.combine(dem(spark, d).select("gx", "gy", "b0"), grid2(spark, d), "subtract"), 4)


def zonal_overlap_order(spark, d):
    burnt = zonal.burn(exact(spark, d), zones(spark, [(1, 7, 10.0, -18.0, 30.0, -4.0), (0, 42, 20.0, -15.0, 41.0, -10.0)]), SHAPE)
    return burnt.select("gx", "gy", "zone_id")


def steps(spark):
    return spark.createDataFrame(STEPS, "ord int, start_ms long, end_ms long")


def resample_bilinear(spark, d):
    return rounded(resample.resample(holed(spark, d), SHAPE, Grid(0.0, 0.0, 1.5, 16), _box(0, 45, 0, 18)), 4)


def reproject_3857(spark, d):
    return rounded(resample.reproject(holed(spark, d).select("gx", "gy", "b0"), GEO, 4326, MERCATOR, 3857, Bbox(785000.0, 5920000.0, 830000.0, 5940000.0)), 4)


def rasterize_rects(spark, d):
    return vector.rasterize(rectangles(spark, d), SHAPE, "v")


def clip_boundary(spark, d):
    return vector.clip_to(rectangles(spark, d), [(10.0, -50.0), (80.0, -40.0), (60.0, -5.0), (20.0, -10.0), (10.0, -50.0)]).select("id", "geometry")


#: A multipolygon: a U with a hole in its right arm, and a square apart.
COURT = [
    [[(10.0, -50.0), (80.0, -50.0), (80.0, -5.0), (60.0, -5.0), (60.0, -35.0), (30.0, -35.0), (30.0, -10.0), (10.0, -10.0), (10.0, -50.0)],
     [(64.0, -30.0), (64.0, -20.0), (72.0, -20.0), (72.0, -30.0), (64.0, -30.0)]],
    [[(2.0, -8.0), (8.0, -8.0), (8.0, -2.0), (2.0, -2.0), (2.0, -8.0)]],
]


def clip_multipolygon(spark, d):
    return vector.measures(vector.clip_to(rectangles(spark, d), COURT)).select("id", "area")


def union_overlapping(spark, d):
    """Each rectangle united with one moved by up to 7 and 5 units: equal, overlapping, touching or apart."""
    one = rectangles(spark, d).select("id", "geometry", "properties")
    k = F.col("s_suppkey")
    x, y = (k * 7 % 90 + k % 8).cast("double"), (-(k * 11 % 60) - k % 6).cast("double")
    ring = F.array(*[F.array(x + dx, y - dy) for dx, dy in ((0, 0), (6, 0), (6, 4), (0, 4), (0, 0))])
    moved = table(spark, d, "supplier").select(k.cast("long").alias("id"), F.concat(F.lit('["Polygon",[['), F.to_json(ring), F.lit("]]]")).alias("geometry"), F.lit(None).cast("map<string, string>").alias("properties"))
    return vector.measures(vector.dissolve(one.unionByName(moved))).select("id", "area", "min_x", "min_y", "max_x", "max_y")


def simplify(spark, d):
    return vector.measures(vector.simplify(rectangles(spark, d), 2.0))


def dissolve(spark, d):
    cut = vector.tiled(rectangles(spark, d), Grid(0.0, 0.0, 1.0, 8), 0, Bbox(0.0, -70.0, 100.0, 0.0))
    return vector.measures(vector.dissolve(cut))


def png_tiles(spark, d):
    """The pixels of PNG tiles, written and decoded again."""
    import numpy as np
    import pyarrow as pa

    def back(batches):
        for batch in batches:
            for ix, iy, body in zip(batch.column("ix").to_pylist(), batch.column("iy").to_pylist(), batch.column("png"), strict=True):
                gray, alpha = codecs.read_png_gray(bytes(body.as_buffer()))
                gy, gx = np.nonzero(alpha)
                yield pa.RecordBatch.from_arrays([pa.array(gx + 16 * ix), pa.array(gy + 16 * iy), pa.array(gray[gy, gx].astype(np.int64))], ["gx", "gy", "gray"])

    return files.png_tiles(raster.gray(holed(spark, d), 900.0, 2000.0), 16).mapInArrow(back, "gx long, gy long, gray long")


def scenes(spark, d):
    """An item a month of the stack: its box is the half of the grid, left or right, or the whole, that the month chooses."""
    month = F.substring("item_id", 6, 2).cast("int") % 3
    items = stack(spark, d).groupBy("item_id").agg(F.first("datetime").alias("datetime"))
    left, right = F.when(month == 1, 7.25).otherwise(7.0), F.when(month == 0, 7.25).otherwise(7.5)
    return items.select("item_id", "datetime", left.alias("min_x"), F.lit(46.6).alias("min_y"), right.alias("max_x"), F.lit(47.0).alias("max_y"))


def catalog_window(spark, d):
    """The mean over the items that meet a window of the right half in 1997."""
    items = catalog.by_block(scenes(spark, d)).withColumns({"epsg": F.lit(4326), "x0": F.lit(GEO.x0), "y0": F.lit(GEO.y0), "size": F.lit(GEO.base)})
    return rounded(catalog.window(stack(spark, d), items, GEO, 4326, Bbox(7.26, 46.7, 7.45, 46.95), "mean", time=Interval(*INTERVAL)))


def catalog_mixed_crs(spark, d):
    """An item on the anchor's grid under a newer one on web mercator: the newest value of each pixel."""
    base = holed(spark, d).select("gx", "gy", "b0")
    old = base.select(F.lit("a").alias("item_id"), F.to_timestamp(F.lit("2020-01-01")).alias("datetime"), "gx", "gy", "b0")
    new = base.select(F.lit("b").alias("item_id"), F.to_timestamp(F.lit("2024-01-01")).alias("datetime"), (F.col("gx") + 13880).alias("gx"), (F.col("gy") + 9420).alias("gy"), (F.col("b0") + 5000).alias("b0"))
    extent = base.agg(F.max("gy")).first()[0] or 0
    box = Bbox(GEO.x0, GEO.y0 - (extent + 1) * GEO.base, GEO.x0 + 50 * GEO.base, GEO.y0)
    # The newer item's box holds all its pixels, and the whole window's height: many rows go on past the pole, as in the SQL.
    x, y, r = MERCATOR.x0 + 13880 * MERCATOR.base, MERCATOR.y0 - 9420 * MERCATOR.base, MERCATOR.base
    there = crs.envelope(Bbox(x, y - (extent + 1) * r, x + 50 * r, y), 3857, 4326)
    rows = [
        ("a", 4326, GEO.x0, GEO.y0, GEO.base, box.min_x, box.min_y, box.max_x, box.max_y),
        ("b", 3857, MERCATOR.x0, MERCATOR.y0, MERCATOR.base, there.min_x, min(there.min_y, box.min_y), there.max_x, there.max_y),
    ]
    items = spark.createDataFrame(rows, "item_id string, epsg int, x0 double, y0 double, size double, min_x double, min_y double, max_x double, max_y double")
    return rounded(catalog.window(old.union(new), items, GEO, 4326, box, "latest"), 4)


def polygon_zones(spark):
    """A triangle, a concave arrow over a part of it, and a square with a hole: ord, id, box, rings."""
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in (*p, p[0])]
    rows = [(o, i, min(p["x"] for p in r[0]), min(p["y"] for p in r[0]), max(p["x"] for p in r[0]), max(p["y"] for p in r[0]), r) for o, i, r in ((o, i, [ring(*x) for x in rings]) for o, i, rings in POLYGONS)]
    return spark.createDataFrame(rows, "ord int, id long, min_x double, min_y double, max_x double, max_y double, rings array<array<struct<x: double, y: double>>>")


#: ord, id, rings of (x, y).
POLYGONS = [(0, 11, [[(1.0, -0.3), (21.0, -2.2), (8.0, -19.4)]]), (1, 12, [[(5.0, -3.3), (18.2, -6.1), (9.1, -8.4), (12.3, -17.7)]]), (2, 13, [[(25.0, -1.2), (45.0, -1.2), (45.0, -15.1), (25.0, -15.1)], [(30.3, -4.4), (40.2, -4.4), (35.0, -12.3)]])]


def geotiff_roundtrip(spark, d):
    import pyarrow as pa

    tiles = files.geotiff_tiles(dem(spark, d), SHAPE, 4326)

    def back(batches):
        for batch in batches:
            for ix, iy, body in zip(batch.column("ix").to_pylist(), batch.column("iy").to_pylist(), batch.column("tiff"), strict=True):
                import numpy as np

                block = codecs.GeoTiff(bytes(body.as_buffer())).window(0, 0, 0, 16, 16)
                gy, gx = np.nonzero(~np.isnan(block).all(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array(gx + 16 * ix), pa.array(gy + 16 * iy), pa.array(block[0, gy, gx]), pa.array(block[1, gy, gx])], ["gx", "gy", "b0", "b1"])

    return tiles.mapInArrow(back, "gx long, gy long, b0 double, b1 double")


def las_roundtrip(spark, d):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            x, y, z = (batch.column(c).to_numpy() for c in "xyz")
            p = codecs.read_las(codecs.write_las(x, y, z, 0, 0))
            yield pa.RecordBatch.from_arrays([batch.column("point_id"), *[pa.array(p[c].round(3)) for c in "xyz"]], ["point_id", "x", "y", "z"])

    return cloud(spark, d).select("point_id", "x", "y", "z").mapInArrow(run, "point_id long, x double, y double, z double")


def xyz_tiles(spark, d):
    from ..functions.grid import xyz_of

    c = dem(spark, d)
    lon, lat = GEO.centre(F.col("gx"), F.col("gy"))
    x, y = xyz_of(lon, lat, 12)
    return c.select(x.alias("x"), y.alias("y")).groupBy("x", "y").agg(F.count("*").alias("pixels"))


def rfc3339(spark, d):
    from ..functions.time import format_rfc3339, parse_rfc3339

    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+02:00"))
    return table(spark, d, "events").select("event_id", parse_rfc3339(text).alias("ms"), format_rfc3339(parse_rfc3339(text)).alias("utc"))


def tile_index_query(spark, d):
    g = Grid(0.0, 100.0, 0.5, 16)
    return points.tile_of(cloud(spark, d), g).groupBy("ix", "iy").agg(F.count("*").alias("points"))


QUERIES = {
    "entry_zonal_index": entry_zonal_index,
    "window_filter": lambda s, d: raster.window(dem(s, d), SHAPE, _box(10, 31, 5, 21)),
    "ladder_l1": lambda s, d: rounded(raster.coarsen(dem(s, d), 1)),
    "ladder_l2": lambda s, d: rounded(raster.coarsen(holed(s, d), 2)),
    "tile_cover_counts": lambda s, d: raster.tile_counts(grid2(s, d), 16),
    "bandmath_arith": lambda s, d: rounded(band_math(dem(s, d), "(b0 - b1) / (b0 + b1) * 2 - -b1 / 4")),
    "bandmath_compare": lambda s, d: band_math(dem(s, d), "b1 > 10 < 1 == (b1 != 25) + (b0 >= 1000) * (b1 <= 40)"),
    "bandmath_where": lambda s, d: band_math(holed(s, d), "where(b1 - 10, b0, b1)"),
    "bandmath_minmax": lambda s, d: rounded(band_math(holed(s, d), "max(b0 / 100, b1) + min(b0 / 100, pow(b1, 2)) + abs(-b1)")),
    "bandmath_log_zero": lambda s, d: rounded(band_math(dem(s, d), "where(b1 - 10, log(abs(b1 - 20) + 0) + exp(0 - b1) + sqrt(b1), 0)")),
    "bandmath_div_zero": lambda s, d: band_math(dem(s, d), "(b1 - 20) / (b1 - 20) + b1 / (1 > 2)"),
    "reclassify": lambda s, d: raster.reclassify(dem(s, d), [(0, 10, 1), (10, 30, 2), (900, 1200, 3)]),
    "unary_algebra": lambda s, d: rounded(raster.unary(holed(s, d), "sqrt")),
    "quality_mask": lambda s, d: raster.quality_mask(dem(s, d).withColumn("b2", (F.col("b1") % 11)), 2, [4, 5]),
    "prop_filter": lambda s, d: vector.feature_filter(event_features(s, d), "k", 42).select("id"),
    "schema_map": lambda s, d: vector.map_properties(event_features(s, d), {"k": "key"}, [], {"src": "events"}).select("id", F.col("properties")["key"].alias("key"), F.col("properties")["src"].alias("src")),
    **{f"composite_{k}": composite_query(k) for k in ("latest", "mean", "median", "min", "max", "stddev", "count")},
    "composite_p90": composite_query("percentile", 90.0),
    "composite_interval": lambda s, d: composite.composite(stack(s, d), "latest", time=Interval(*INTERVAL)),
    "catalog_anchor": catalog_anchor,
    "zonal_stats": lambda s, d: zonal.zonal_statistics(exact(s, d), zones(s), SHAPE),
    "zonal_overlap_order": zonal_overlap_order,
    "zonal_polygons": lambda s, d: zonal.zonal_statistics(exact(s, d), polygon_zones(s), SHAPE),
    "catalog_window": catalog_window,
    "catalog_mixed_crs": catalog_mixed_crs,
    "zonal_empty_rows": lambda s, d: rounded(zonal.with_empty_zones(zonal.zonal_statistics(exact(s, d), zones(s), SHAPE), zones(s))),
    "window_stats": lambda s, d: rounded(zonal.window_statistics(raster.window(exact(s, d), SHAPE, _box(5, 20, 2, 12)))),
    "zonal_series": lambda s, d: rounded(zonal.zonal_series(event_stack(s, d), steps(s), zones(s), SHAPE, composite.reducer("max"))),
    "window_series": lambda s, d: rounded(zonal.window_series(event_stack(s, d), steps(s), composite.reducer("mean")), 4),
    "mosaic_first_wins": mosaic_first_wins,
    "combine_sub": combine_sub,
    "focal_mean": lambda s, d: rounded(focal.focal(holed(s, d), "mean", 2)),
    "focal_min": lambda s, d: focal.focal(holed(s, d), "min", 1),
    "focal_max": lambda s, d: focal.focal(holed(s, d), "max", 1),
    "focal_median": lambda s, d: rounded(focal.focal(holed(s, d), "median", 1)),
    "hillshade": lambda s, d: rounded(focal.hillshade(dem(s, d), 30.0), 4),
    "slope": lambda s, d: rounded(focal.slope(dem(s, d), 30.0), 4),
    "aspect": lambda s, d: rounded(focal.aspect(dem(s, d), 30.0), 4),
    "tensor_scale": lambda s, d: rounded(tensor.to_raster(tensor.to_tensor(dem(s, d), [0.5, 2.0], [0.25, -1.0])), 2),
    "tensor_conv": lambda s, d: rounded(tensor.to_raster(focal.convolve(tensor.to_tensor(dem(s, d).select("gx", "gy", F.col("b1").alias("b0")), [1.0], [0.0]), [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0])), 2),
    "resample_bilinear": resample_bilinear,
    "reproject_3857": reproject_3857,
    "voxel_thin": lambda s, d: points.voxel_thin(cloud(s, d).select("x", "y", "z", "point_id"), 8.0),
    "idw_grid": lambda s, d: rounded(points.idw(cloud(s, d).select("x", "y", "z", "point_id"), Grid(0.0, 40.0, 2.0, 16), 2.0, 1.5, 2)),
    "rasterize_rects": rasterize_rects,
    "point_tile_membership": tile_index_query,
    "gray_encode": lambda s, d: raster.gray(holed(s, d), 900.0, 2000.0),
    "xyz_tiles": xyz_tiles,
    "rfc3339": rfc3339,
    "clip_boundary": clip_boundary,
    "clip_multipolygon": clip_multipolygon,
    "union_overlapping": union_overlapping,
    "simplify": simplify,
    "dissolve": dissolve,
    "png_tiles": png_tiles,
    "geotiff_roundtrip": geotiff_roundtrip,
    "las_roundtrip": las_roundtrip,
}

_DEM = "dem AS (SELECT p_partkey % 50 AS gx, p_partkey // 50 AS gy, p_retailprice AS b0, CAST(p_size AS DOUBLE) AS b1 FROM part)"
_HOLED = _DEM + ", holed AS (SELECT gx, gy, CASE WHEN b1 % 7 <> 0 THEN b0 END AS b0, b1 FROM dem)"
_GRID2 = "grid2 AS (SELECT o_orderkey % 125 AS gx, o_orderkey // 125 AS gy, o_totalprice AS b0 FROM orders)"
_EXACT = _DEM + ", exact AS (SELECT gx, gy, CAST(gx + 1000 * gy AS DOUBLE) AS b0 FROM dem)"
_STACK = "stack AS (SELECT strftime(l_shipdate, '%Y-%m') AS item_id, l_partkey % 50 AS gx, l_suppkey % 40 AS gy, CAST(max(l_quantity) AS DOUBLE) AS b0, CAST(max(round(l_discount * 100)) AS DOUBLE) AS b1 FROM lineitem GROUP BY 1, 2, 3)"
_CLOUD = "cloud AS (SELECT CAST(user_id AS DOUBLE) AS x, CAST(value AS DOUBLE) AS y, CAST(event_id % 97 AS DOUBLE) AS z, event_id AS point_id FROM events)"
_EVENTS = "es AS (SELECT ts, user_id % 40 AS gx, event_id % 20 AS gy, floor(CAST(value AS DOUBLE)) AS b0 FROM events)"
_ZONES = "zones(ord, id, min_x, min_y, max_x, max_y) AS (VALUES " + ", ".join(f"({o}, CAST({i} AS BIGINT), {a:.1f}, {b:.1f}, {c:.1f}, {e:.1f})" for o, i, a, b, c, e in ZONES) + ")"
_STEPS = "steps(step, start_ms, end_ms) AS (VALUES " + ", ".join(map(str, STEPS)) + ")"
_IN = "gx + 0.5 >= min_x AND gx + 0.5 < max_x AND -(gy + 0.5) > min_y AND -(gy + 0.5) <= max_y"
_STATS = "count(b0) AS count, coalesce(sum(b0), 0.0) AS sum, min(b0) AS minimum, max(b0) AS maximum"


def _zonal(source: str, digits: str = "{}") -> str:
    r = digits.format
    return f"burnt AS (SELECT gx, gy, b0, arg_max(id, ord) AS zone_id FROM {source} JOIN zones ON {_IN} GROUP BY gx, gy, b0) SELECT zone_id, count(b0) AS count, {r('sum(b0)')} AS sum, {r('min(b0)')} AS minimum, {r('max(b0)')} AS maximum, {r('avg(b0)')} AS mean FROM burnt GROUP BY zone_id HAVING count(b0) > 0"


def _composite(expr: str) -> str:
    f = lambda b: expr.replace("?", b)
    return f"WITH {_STACK} SELECT gx, gy, round({f('b0')}, 6) AS b0, round({f('b1')}, 6) AS b1 FROM stack GROUP BY gx, gy"


def _focal(expr: str, r: int) -> str:
    f = lambda b: f"CASE WHEN max(CASE WHEN n.gx = c.gx AND n.gy = c.gy THEN n.{b} END) IS NOT NULL THEN {expr.replace('?', 'n.' + b)} END AS {b}"
    return f"WITH {_HOLED} SELECT c.gx, c.gy, {f('b0')}, {f('b1')} FROM holed c JOIN holed n ON n.gx BETWEEN c.gx - {r} AND c.gx + {r} AND n.gy BETWEEN c.gy - {r} AND c.gy + {r} GROUP BY c.gx, c.gy"


def _around(source: str, band: str = "b0") -> str:
    taps = ", ".join(f"max(CASE WHEN n.gx = c.gx + {dx} AND n.gy = c.gy + {dy} THEN n.{band} END) AS n{dy + 1}{dx + 1}" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    return f"near AS (SELECT c.gx, c.gy, {taps} FROM {source} c JOIN {source} n ON abs(n.gx - c.gx) <= 1 AND abs(n.gy - c.gy) <= 1 GROUP BY c.gx, c.gy)"


_HORN = _DEM + ", " + _around("dem") + ", horn AS (SELECT gx, gy, ((n02 + 2*n12 + n22) - (n00 + 2*n10 + n20)) / 240.0 AS e, ((n00 + 2*n01 + n02) - (n20 + 2*n21 + n22)) / 240.0 AS n FROM near), g AS (SELECT gx, gy, CASE WHEN n IS NOT NULL THEN e END AS e, CASE WHEN e IS NOT NULL THEN n END AS n FROM horn)"


def _bilinear(wanted: str, names: list[str]) -> str:
    """wanted: SQL for o(gx, gy, u, v)."""
    blends = ", ".join(
        f"round(CASE WHEN count({b}) = 4 THEN max(CASE WHEN k = 0 THEN w * {b} END) + max(CASE WHEN k = 1 THEN w * {b} END) + max(CASE WHEN k = 2 THEN w * {b} END) + max(CASE WHEN k = 3 THEN w * {b} END) ELSE arg_max({b}, struct_pack(w := w, k := k)) FILTER (WHERE {b} IS NOT NULL AND w > 1e-6) END, 4) AS {b}"
        for b in names)
    return f"""o AS ({wanted}), p AS (SELECT gx, gy, floor(u) AS x0, floor(v) AS y0, u - floor(u) AS fx, v - floor(v) AS fy FROM o),
    t AS (SELECT gx, gy, k, x0 + k % 2 AS sx, y0 + k // 2 AS sy, (CASE WHEN k % 2 = 1 THEN fx ELSE 1 - fx END) * (CASE WHEN k // 2 = 1 THEN fy ELSE 1 - fy END) AS w FROM p, (VALUES (0), (1), (2), (3)) AS q(k)),
    m AS (SELECT t.gx, t.gy, t.k, t.w, {", ".join("s." + b for b in names)} FROM t JOIN holed s ON s.gx = t.sx AND s.gy = t.sy)
    SELECT gx, gy, {blends} FROM m GROUP BY gx, gy"""


_PI = "3.141592653589793"
_RECTS = """SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(24 AS DOUBLE) AS area, CAST(s_suppkey * 7 % 90 AS DOUBLE) AS min_x, CAST(-(s_suppkey * 11 % 60) - 4 AS DOUBLE) AS min_y,
    CAST(s_suppkey * 7 % 90 + 6 AS DOUBLE) AS max_x, CAST(-(s_suppkey * 11 % 60) AS DOUBLE) AS max_y, CAST(5 AS BIGINT) AS positions FROM supplier"""
_EDGES = "edges(ord, id, ax, ay, bx, by_) AS (VALUES " + ", ".join(
    f"({o}, CAST({i} AS BIGINT), CAST({a[0]} AS DOUBLE), CAST({a[1]} AS DOUBLE), CAST({b[0]} AS DOUBLE), CAST({b[1]} AS DOUBLE))" for o, i, rings in POLYGONS for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True)) + ")"
ORACLES = {
    "entry_zonal_index": f"WITH {_STACK}, {_ZONES}, med AS (SELECT gx, gy, median(b0) AS m0, median(b1) AS m1 FROM stack GROUP BY gx, gy), idx AS (SELECT gx, gy, (m0 - m1) / (m0 + m1) AS b0 FROM med), " + _zonal("idx", "round({}, 6)"),
    "window_filter": f"WITH {_DEM} SELECT * FROM dem WHERE gx BETWEEN 10 AND 30 AND gy BETWEEN 5 AND 20",
    "ladder_l1": f"WITH {_DEM} SELECT gx // 2 AS gx, gy // 2 AS gy, round(avg(b0), 6) AS b0, round(avg(b1), 6) AS b1 FROM dem GROUP BY 1, 2",
    "ladder_l2": f"WITH {_HOLED} SELECT gx // 4 AS gx, gy // 4 AS gy, round(avg(b0), 6) AS b0, round(avg(b1), 6) AS b1 FROM holed GROUP BY 1, 2",
    "tile_cover_counts": f"WITH {_GRID2} SELECT gx // 16 AS ix, gy // 16 AS iy, count(*) AS pixels FROM grid2 GROUP BY 1, 2",
    "bandmath_arith": f"WITH {_DEM} SELECT gx, gy, round((b0 - b1) / (b0 + b1) * 2 + b1 / 4, 6) AS b0 FROM dem",
    "bandmath_compare": f"WITH {_DEM} SELECT gx, gy, CAST((CAST((CAST(b1 > 10 AS DOUBLE) < 1) AS DOUBLE) = CAST(b1 <> 25 AS DOUBLE) + CAST(b0 >= 1000 AS DOUBLE) * CAST(b1 <= 40 AS DOUBLE)) AS DOUBLE) AS b0 FROM dem",
    "bandmath_where": f"WITH {_HOLED} SELECT gx, gy, CASE WHEN b0 IS NOT NULL AND b1 IS NOT NULL THEN CASE WHEN b1 = 10 THEN b1 ELSE b0 END END AS b0 FROM holed",
    "bandmath_minmax": f"WITH {_HOLED} SELECT gx, gy, CASE WHEN b0 IS NOT NULL THEN round(greatest(b0 / 100, b1) + least(b0 / 100, pow(b1, 2)) + abs(-b1), 6) END AS b0 FROM holed",
    "bandmath_log_zero": f"WITH {_DEM} SELECT gx, gy, CASE WHEN b1 = 10 THEN 0.0 WHEN b1 = 20 THEN CAST('-inf' AS DOUBLE) ELSE round(ln(abs(b1 - 20)) + exp(-b1) + sqrt(b1), 6) END AS b0 FROM dem",
    "bandmath_div_zero": f"WITH {_DEM} SELECT gx, gy, CASE WHEN b1 = 20 OR b1 = 0 THEN NULL ELSE CAST('inf' AS DOUBLE) END AS b0 FROM dem",
    "reclassify": f"WITH {_DEM} SELECT gx, gy, " + ", ".join(f"CASE WHEN {b} >= 0 AND {b} < 10 THEN 1.0 WHEN {b} >= 10 AND {b} < 30 THEN 2.0 WHEN {b} >= 900 AND {b} < 1200 THEN 3.0 END::DOUBLE AS {b}" for b in ("b0", "b1")) + " FROM dem",
    "unary_algebra": f"WITH {_HOLED} SELECT gx, gy, round(sqrt(b0), 6) AS b0, round(sqrt(b1), 6) AS b1 FROM holed",
    "quality_mask": f"WITH {_DEM} SELECT gx, gy, CASE WHEN b1 % 11 IN (4, 5) THEN b0 END AS b0, CASE WHEN b1 % 11 IN (4, 5) THEN b1 END AS b1, CASE WHEN b1 % 11 IN (4, 5) THEN b1 % 11 END AS b2 FROM dem",
    "prop_filter": "SELECT event_id AS id FROM events WHERE CAST(json_extract(props, '$.k') AS VARCHAR) = '42'",
    "schema_map": "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS VARCHAR) AS key, '\"events\"' AS src FROM events",
    "composite_latest": _composite("arg_max(?, item_id)"),
    "composite_mean": _composite("avg(?)"),
    "composite_median": _composite("median(?)"),
    "composite_min": _composite("min(?)"),
    "composite_max": _composite("max(?)"),
    "composite_stddev": _composite("stddev_pop(?)"),
    "composite_count": _composite("CAST(count(?) AS DOUBLE)"),
    "composite_p90": _composite("quantile_cont(?, 0.9)"),
    "composite_interval": f"WITH {_STACK} SELECT gx, gy, arg_max(b0, item_id) AS b0, arg_max(b1, item_id) AS b1 FROM stack WHERE item_id BETWEEN '1997-01' AND '1997-12' GROUP BY gx, gy",
    "catalog_anchor": f"WITH {_STACK} SELECT item_id, item_id || '-01T00:00:00Z' AS datetime, count(*) AS pixels FROM stack GROUP BY item_id ORDER BY item_id DESC LIMIT 1",
    "zonal_stats": f"WITH {_EXACT}, {_ZONES}, " + _zonal("exact"),
    "zonal_overlap_order": f"WITH {_EXACT}, z(ord, id, min_x, min_y, max_x, max_y) AS (VALUES (1, 7::BIGINT, 10.0, -18.0, 30.0, -4.0), (0, 42::BIGINT, 20.0, -15.0, 41.0, -10.0)) SELECT gx, gy, arg_max(id, ord) AS zone_id FROM exact JOIN z ON {_IN} GROUP BY gx, gy",
    "zonal_empty_rows": f"WITH {_EXACT}, {_ZONES}, found AS (WITH " + _zonal("exact") + ") SELECT ord, id AS zone_id, coalesce(count, 0) AS count, coalesce(sum, 0.0) AS sum, minimum, maximum, round(mean, 6) AS mean FROM zones LEFT JOIN found ON zone_id = id",
    "window_stats": f"WITH {_EXACT} SELECT {_STATS}, round(avg(b0), 6) AS mean FROM exact WHERE gx BETWEEN 5 AND 19 AND gy BETWEEN 2 AND 11",
    "zonal_series": f"WITH {_EVENTS}, {_STEPS}, {_ZONES}, px AS (SELECT step, gx, gy, max(b0) AS b0 FROM es JOIN steps ON epoch_us(ts) // 1000 >= start_ms AND epoch_us(ts) // 1000 < end_ms GROUP BY 1, 2, 3), place AS (SELECT gx, gy, arg_max(id, ord) AS zone_id FROM (SELECT DISTINCT gx, gy FROM px) JOIN zones ON {_IN} GROUP BY gx, gy) SELECT step, zone_id, {_STATS}, round(avg(b0), 6) AS mean FROM px JOIN place USING (gx, gy) GROUP BY step, zone_id",
    "window_series": f"WITH {_EVENTS}, {_STEPS}, px AS (SELECT step, gx, gy, avg(b0) AS b0 FROM es JOIN steps ON epoch_us(ts) // 1000 >= start_ms AND epoch_us(ts) // 1000 < end_ms GROUP BY 1, 2, 3) SELECT step, count(b0) AS count, round(sum(b0), 4) AS sum, round(min(b0), 4) AS minimum, round(max(b0), 4) AS maximum, round(avg(b0), 4) AS mean FROM px GROUP BY step",
    "mosaic_first_wins": f"WITH {_HOLED}, {_GRID2} SELECT gx, gy, coalesce(h.b0, g.b0) AS b0 FROM holed h FULL JOIN grid2 g USING (gx, gy)",
    "combine_sub": f"WITH {_DEM}, {_GRID2} SELECT gx, gy, round(dem.b0 - grid2.b0, 4) AS b0 FROM dem JOIN grid2 USING (gx, gy)",
    "focal_mean": _focal("round(avg(?), 6)", 2),
    "focal_min": _focal("min(?)", 1),
    "focal_max": _focal("max(?)", 1),
    "focal_median": _focal("round(median(?), 6)", 1),
    "hillshade": f"WITH {_HORN} SELECT gx, gy, round(CASE WHEN e IS NOT NULL THEN greatest((cos(radians(45)) - (e * sin(radians(315)) + n * cos(radians(315))) * sin(radians(45))) / sqrt(e*e + n*n + 1), 0.0) * 255 END, 4) AS b0 FROM g",
    "slope": f"WITH {_HORN} SELECT gx, gy, round(degrees(atan(sqrt(e*e + n*n))), 4) AS b0 FROM g",
    "aspect": f"WITH {_HORN} SELECT gx, gy, CASE WHEN e <> 0 OR n <> 0 THEN round((degrees(atan2(-e, -n)) + 360.0) % 360.0, 4) END AS b0 FROM g",
    "tensor_scale": f"WITH {_DEM} SELECT gx, gy, round(CAST(CAST(b0 AS FLOAT) * CAST(0.5 AS FLOAT) + CAST(0.25 AS FLOAT) AS DOUBLE), 2) AS b0, round(CAST(CAST(b1 AS FLOAT) * CAST(2 AS FLOAT) + CAST(-1 AS FLOAT) AS DOUBLE), 2) AS b1 FROM dem",
    "tensor_conv": f"WITH {_DEM}, {_around('dem', 'b1')} SELECT gx, gy, CASE WHEN n11 IS NOT NULL THEN " + " + ".join(f"coalesce(n{i // 3}{i % 3}, 0) * {i + 1}" for i in range(9)) + " END AS b0 FROM near",
    "resample_bilinear": f"WITH {_HOLED}, " + _bilinear("SELECT gx, gy, (gx + 0.5) * 1.5 - 0.5 AS u, (gy + 0.5) * 1.5 - 0.5 AS v FROM range(0, 30) a(gx), range(0, 12) b(gy)", ["b0", "b1"]),
    "reproject_3857": f"WITH {_HOLED}, " + _bilinear(
        f"SELECT gx, gy, ((-20037508.342789244 + (gx + 0.5) * 1500.0) * (180 / {_PI} / 6378137.0) - 7.0) / 0.01 - 0.5 AS u, (47.0 - (atan(exp((20037508.342789244 - (gy + 0.5) * 1500.0) * (1 / 6378137.0))) * 2 - {_PI} / 2) * (180 / {_PI})) / 0.01 - 0.5 AS v"
        " FROM range(CAST(floor((785000.0 + 20037508.342789244) / 1500) AS BIGINT), CAST(ceil((830000.0 + 20037508.342789244) / 1500) AS BIGINT)) a(gx), range(CAST(floor((20037508.342789244 - 5940000.0) / 1500) AS BIGINT), CAST(ceil((20037508.342789244 - 5920000.0) / 1500) AS BIGINT)) b(gy)", ["b0"]),
    "voxel_thin": f"WITH {_CLOUD}, r AS (SELECT *, row_number() OVER (PARTITION BY floor(x / 8), floor(y / 8), floor(z / 8) ORDER BY point_id) AS i FROM cloud) SELECT x, y, z, point_id FROM r WHERE i = 1",
    "idw_grid": f"WITH {_CLOUD}, c AS (SELECT x, y, z, point_id, CAST(floor(x / 2) AS BIGINT) AS px, CAST(floor((40 - y) / 2) AS BIGINT) AS py FROM cloud), m AS (SELECT px + dx AS gx, py + dy AS gy, z, point_id, sqrt((x - (px + dx + 0.5) * 2) ** 2 + (y - (40 - (py + dy + 0.5) * 2)) ** 2) AS d FROM c, range(-2, 3) a(dx), range(-2, 3) b(dy)) SELECT gx, gy, round(coalesce(arg_min(z, point_id) FILTER (WHERE d = 0), sum(z / (d * d)) FILTER (WHERE d > 0) / sum(1 / (d * d)) FILTER (WHERE d > 0)), 6) AS b0 FROM m WHERE d <= 3 GROUP BY gx, gy HAVING count(*) >= 2",
    "rasterize_rects": "WITH s AS (SELECT s_suppkey AS id, s_suppkey * 7 % 90 AS x, s_suppkey * 11 % 60 AS y FROM supplier WHERE s_suppkey % 5 <> 0) SELECT x + dx AS gx, y + dy AS gy, CAST(arg_max(id % 13, id) AS DOUBLE) AS b0 FROM s, range(0, 6) a(dx), range(0, 4) b(dy) GROUP BY 1, 2",
    "point_tile_membership": f"WITH {_CLOUD} SELECT CAST(floor(x / 8) AS BIGINT) AS ix, CAST(floor((100 - y) / 8) AS BIGINT) AS iy, count(*) AS points FROM cloud GROUP BY 1, 2",
    "gray_encode": f"WITH {_HOLED} SELECT gx, gy, CAST(coalesce(round(least(greatest((b0 - 900) / 1100, 0.0), 1.0) * 255), 0) AS BIGINT) AS gray, CAST(CASE WHEN b0 IS NULL THEN 0 ELSE 255 END AS BIGINT) AS alpha FROM holed",
    "xyz_tiles": f"WITH {_DEM}, g AS (SELECT 7.0 + (gx + 0.5) * 0.01 AS lon, radians(47.0 - (gy + 0.5) * 0.01) AS lat FROM dem) SELECT CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS x, CAST(floor((1 - ln(tan(lat) + 1 / cos(lat)) / {_PI}) / 2 * 4096) AS BIGINT) AS y, count(*) AS pixels FROM g GROUP BY 1, 2",
    "rfc3339": "WITH t AS (SELECT event_id, epoch_us(ts) // 1000 - 7200000 AS ms FROM events) SELECT event_id, ms, strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ms % 1000 <> 0 THEN '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') ELSE '' END || 'Z' AS utc FROM t",
    "simplify": _RECTS,
    "dissolve": _RECTS,
    "clip_multipolygon": f"WITH r AS ({_RECTS}), block(x0, y0, x1, y1, sign) AS (VALUES (10, -50, 30, -10, 1), (30, -50, 60, -35, 1), (60, -50, 80, -5, 1), (64, -30, 72, -20, -1), (2, -8, 8, -2, 1)),"
    " met AS (SELECT id, sign * greatest(0, least(max_x, x1) - greatest(min_x, x0)) * greatest(0, least(max_y, y1) - greatest(min_y, y0)) AS part FROM r, block)"
    " SELECT id, CAST(sum(part) AS DOUBLE) AS area FROM met GROUP BY id HAVING sum(part) > 0",
    "union_overlapping": f"WITH r AS ({_RECTS}) SELECT id, CAST(48 - greatest(0, 6 - id % 8) * greatest(0, 4 - id % 6) AS DOUBLE) AS area, min_x, CAST(min_y - id % 6 AS DOUBLE) AS min_y, CAST(max_x + id % 8 AS DOUBLE) AS max_x, max_y FROM r",
    "png_tiles": f"WITH {_HOLED} SELECT gx, gy, CAST(round(least(greatest((b0 - 900) / 1100, 0.0), 1.0) * 255) AS BIGINT) AS gray FROM holed WHERE b0 IS NOT NULL",
    "zonal_polygons": f"WITH {_EXACT}, {_EDGES}, hit AS (SELECT gx, gy, b0, ord, id FROM exact JOIN edges ON (ay <= -(gy + 0.5)) <> (by_ <= -(gy + 0.5)) AND gx + 0.5 < ax + (-(gy + 0.5) - ay) * (bx - ax) / (by_ - ay)"
    " GROUP BY gx, gy, b0, ord, id HAVING count(*) % 2 = 1), last AS (SELECT gx, gy, b0, arg_max(id, ord) AS zone_id FROM hit GROUP BY gx, gy, b0)"
    f" SELECT zone_id, {_STATS}, avg(b0) AS mean FROM last GROUP BY zone_id",
    "catalog_window": f"WITH {_STACK}, s AS (SELECT *, CAST(substr(item_id, 6, 2) AS INT) % 3 AS m FROM stack WHERE item_id BETWEEN '1997-01' AND '1997-12')"
    " SELECT gx, gy, round(avg(b0), 6) AS b0, round(avg(b1), 6) AS b1 FROM s WHERE m <> 0 AND gx BETWEEN 26 AND 44 AND gy BETWEEN 5 AND 29 GROUP BY gx, gy",
    "catalog_mixed_crs": f"WITH {_DEM}, base AS (SELECT gx, gy, CASE WHEN b1 % 7 <> 0 THEN b0 END AS b0 FROM dem), holed AS (SELECT gx + 13880 AS gx, gy + 9420 AS gy, b0 + 5000 AS b0 FROM base), new AS (WITH "
    + _bilinear(f"SELECT gx, gy, ((7.0 + (gx + 0.5) * 0.01) * ({_PI} / 180 * 6378137.0) + 20037508.342789244) / 1500.0 - 0.5 AS u, (20037508.342789244 - ln(tan((47.0 - (gy + 0.5) * 0.01) * ({_PI} / 360) + {_PI} / 4)) * 6378137.0) / 1500.0 - 0.5 AS v FROM range(0, 50) a(gx), range(0, (SELECT max(gy) + 1 FROM base)) b(gy)", ["b0"])
    + ") SELECT gx, gy, coalesce(n.b0, round(o.b0, 4)) AS b0 FROM base o FULL JOIN new n USING (gx, gy)",
    "geotiff_roundtrip": f"WITH {_DEM} SELECT gx, gy, b0, b1 FROM dem",
    "las_roundtrip": f"WITH {_CLOUD} SELECT point_id, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM cloud",
}
