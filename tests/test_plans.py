import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille import errors as E
from quadrille.functions import crs
from quadrille.functions import geometry as G
from quadrille.functions.grid import Bbox, Grid, Interval, Window, xyz_box
from quadrille.functions.time import format_rfc3339, parse_interval, parse_rfc3339
from quadrille.operators import catalog, composite, focal, points, raster, resample, vector
from quadrille.plans import layers
from quadrille.plans.bandmath import band_math, compile_expression
from quadrille.plans.caps import Format, at_least, one_of
from quadrille.plans.graph import Fanin, Graph, Reproject, Source, Transform
from quadrille.sources import codecs, files
from quadrille.streaming import live


def cells(spark, rows):
    n = len(rows[0]) - 2
    return spark.createDataFrame(rows, "gx long, gy long, " + ", ".join(f"b{i} double" for i in range(n)))


@pytest.mark.parametrize(
    "text, want",
    [("b0 + b1 * 2", 8.0), ("(b0 + b1) * 2", 10.0), ("b0 < b1 < 2", 1.0), ("-b0 - -b1", 1.0), ("b0 / 0", math.inf), ("0 / 0", None), ("log(0)", -math.inf), ("log(0 - 1)", None),
     ("sqrt(0 - 1)", None), ("where(0, b0, b1)", 3.0), ("where(1, b0, b2)", None), ("min(b0, b2)", None), ("max(b0, b1)", 3.0), ("pow(b2, 0)", None), ("b2 == b2", None), ("2 != 2", 0.0), ("abs(0 - 2.5)", 2.5)],
)
def test_band_math(spark, text, want):
    got = band_math(cells(spark, [(0, 0, 2.0, 3.0, None)]), text).first()["b0"]
    assert got == want


def test_band_math_errors():
    """From the grammar: every prefix of an expression that stops before an operand is open, every function refuses a wrong number of
    arguments and an unknown name is named."""
    whole = ["2", "*", "pow", "(", "b1", "-", "3", ",", "b2", "/", "4", ")"]
    for k in range(len(whole)):
        if k == 0 or whole[k - 1] not in ("2",):
            with pytest.raises(E.ComputeError):
                compile_expression(" ".join(whole[:k]))
    compile_expression(" ".join(whole))
    takes = {"sqrt": 1, "exp": 1, "max": 2, "pow": 2, "where": 3}
    for name, n in takes.items():
        for k in range(1, 5):
            text = f"{name}({', '.join(['b7'] * k)})"
            if k == n:
                compile_expression(text)
            else:
                with pytest.raises(E.ComputeError, match=str(n)):
                    compile_expression(text)
    for text, name in (("cosine(b2)", "cosine"), ("1 + height", "height"), ("b3 ? 2", r"\?"), ("5 6", "trailing")):
        with pytest.raises(E.ComputeError, match=name):
            compile_expression(text)


def test_grid():
    g = Grid(7.0, 47.0, 0.001)
    assert g.level_for(0.0005) == 0 and g.level_for(0.003) == 1 and g.level_for(0.004) == 2
    assert g.aligned(Bbox(7.0, 46.99, 7.01, 47.0), 0) == (0, 9, 0, 9)
    assert g.tiles(Bbox(7.0, 46.6, 7.6, 47.0), 0) == (0, 2, 0, 1)
    assert not Bbox(0, 0, 1, 1).intersects(Bbox(1, 0, 2, 1))
    with pytest.raises(E.PullTooLarge):
        g.tiles(Bbox(-180, -90, 180, 90), 0, most=10)


def test_time(spark):
    rows = ["2024-06-01T00:00:00Z", "2024-06-01t12:00:00.1239+02:00", "1969-12-31T23:59:59.5Z", "2024-12-31T23:59:60Z", "2024-13-01T00:00:00Z", "2023-02-29T00:00:00Z", "2024-06-01", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(parse_rfc3339(F.col("t"))).collect()]
    assert got == [1717200000000, 1717236000123, -500, 1735689600000, None, None, None, None]
    assert df.select(format_rfc3339(parse_rfc3339(F.col("t")))).collect()[1][0] == "2024-06-01T10:00:00.123Z"
    both = spark.createDataFrame([("2024-01-01T00:00:00Z/2024-01-01T00:00:00Z",), ("2024-01-02T00:00:00Z/2024-01-01T00:00:00Z",)], "t string").select(parse_interval(F.col("t")).alias("i")).collect()
    assert both[0]["i"] is not None and both[1]["i"] is None


def test_crs_round_trips():
    for epsg, lon, lat in ((3857, 7.3, 46.8), (32632, 7.3, 46.8), (32733, 15.2, -33.0)):
        x, y = crs.transform(4326, epsg)(lon, lat)
        assert np.allclose(crs.transform(epsg, 4326)(x, y), (lon, lat), atol=1e-8)
    assert np.allclose(crs.transform(4326, 32632)(9.0, 0.0), (500000.0, 0.0), atol=1e-3)
    with pytest.raises(E.ProjectionError):
        crs.transform(4326, 2056)


def test_terrain_planes(spark):
    east = cells(spark, [(x, y, 10.0 * x) for x in range(5) for y in range(5)])
    north = cells(spark, [(x, y, 10.0 * (5 - y)) for x in range(5) for y in range(5)])
    flat = cells(spark, [(x, y, 100.0) for x in range(5) for y in range(5)])
    centre = lambda df: df.where("gx = 2 and gy = 2").first()["b0"]
    assert centre(focal.aspect(east)) == 270 and centre(focal.aspect(north)) == 180 and centre(focal.aspect(flat)) is None
    assert abs(centre(focal.slope(east, 10.0)) - 45) < 1e-9
    assert abs(centre(focal.hillshade(flat)) - 255 * math.cos(math.radians(45))) < 1e-9


def test_blocks_do_not_show(spark):
    c = cells(spark, [(x, y, float((x * 7 + y * 3) % 11)) for x in range(-9, 20) for y in range(-6, 15) if (x + y) % 5])
    for kind in ("mean", "min", "max", "median"):
        assert sorted(map(tuple, focal.focal(c, kind, 2, block=4).collect())) == sorted(map(tuple, focal.focal(c, kind, 2).collect()))


def test_window_filter_reaches_the_scan(spark, tmp_path):
    c = cells(spark, [(x, y, 1.0) for x in range(40) for y in range(40)])
    c.write.parquet(str(tmp_path / "t"))
    plan = raster.window(spark.read.parquet(str(tmp_path / "t")), Grid(0.0, 0.0, 1.0, 16), Bbox(3, -9, 7, -2))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(gx), IsNotNull(gy), GreaterThanOrEqual(gx,3)" in plan


def test_bilinear_and_holes(spark):
    c = cells(spark, [(0, 0, 0.0), (1, 0, 10.0), (0, 1, 20.0), (1, 1, 30.0)])
    got = {(r.gx, r.gy): r.b0 for r in resample.resample(c, Grid(0.0, 0.0, 1.0), Grid(0.5, -0.5, 1.0), Bbox(0.5, -1.5, 1.5, -0.5)).collect()}
    assert got[0, 0] == 15.0
    holed = c.where("not (gx = 0 and gy = 0)")
    got = {(r.gx, r.gy): r.b0 for r in resample.resample(holed, Grid(0.0, 0.0, 1.0), Grid(0.5, -0.5, 1.0), Bbox(0.5, -1.5, 1.5, -0.5)).collect()}
    assert got[0, 0] == 30.0  # equal weights: the later tap


def test_composites(spark):
    rows = [("a", "2020-01-01 00:00:00", 0, 0, 1.0), ("b", "2022-01-01 00:00:00", 0, 0, 2.0), ("c", "2024-01-01 00:00:00", 0, 0, None), ("c", "2024-01-01 00:00:00", 1, 0, None), ("d", "2023-01-01 00:00:00", 0, 0, math.inf)]
    s = spark.createDataFrame(rows, "item_id string, datetime string, gx long, gy long, b0 double").withColumn("datetime", F.to_timestamp("datetime"))
    got = lambda k, p=None: {r.gx: r.b0 for r in composite.composite(s, k, p).collect()}
    assert got("latest") == {0: math.inf, 1: None} and got("mean") == {0: 1.5, 1: None} and got("count") == {0: 2.0, 1: None}
    assert got("percentile", 90.0)[0] == pytest.approx(1.9) and got("stddev")[0] == 0.5


def test_formats_and_graph(spark):
    a, b = Format("raster", count=at_least(2), crs=one_of(4326)), Format("raster", count=one_of(3, 2))
    assert a.meet(b).settled().count == 3 and Format("points").meet(a) is None
    with pytest.raises(E.Unfixable):
        Format("raster").settled()
    c = cells(spark, [(x, y, float(x), 1.0) for x in range(8) for y in range(8)])
    src = lambda epsg: Source(c, Grid(0.0, 8.0, 1.0), [Format("raster", count=one_of(2), crs=one_of(epsg))])
    g = Graph()
    s, t = g.add(src(4326)), g.add(src(4326))
    m = g.add(Fanin(lambda parts, grid: raster.mosaic(*parts)), s, t)
    k = g.add(Transform(lambda df, grid: band_math(df, "b0 - b1"), makes=Format("raster", count=one_of(1)), passes=("dtype", "crs", "chunk", "resolution")), m)
    engine = g.build()
    assert engine.caps(k).count == 1
    assert {(r.gx, r.gy): r.b0 for r in engine.pull(k, Window(Bbox(2, 4, 4, 6), 1.0)).collect()} == {(x, y): x - 1.0 for x in (2, 3) for y in (2, 3)}
    with pytest.raises(E.KindError):
        engine.pull(k, Window(Bbox(2, 4, 4, 6), 1.0), "points")
    with pytest.raises(E.InvalidGraph):
        g.add(Fanin(lambda p, grid: p[0]), s)
    g = Graph()
    s, t = g.add(src(4326)), g.add(src(3857))
    engine = (lambda n: g.build())(g.add(Fanin(lambda parts, grid: raster.mosaic(*parts)), s, t))
    assert len(engine.plan) == 4  # a reprojection was put in, onto the first parent's CRS
    strict = Transform(lambda df, grid: df, accepts=[Format("raster", count=at_least(5))])
    g2 = Graph()
    g2.add(strict, g2.add(src(4326)))
    with pytest.raises(E.EmptyLink):
        g2.build()


def test_vectors_and_points_in_the_graph(spark):
    box = ("Polygon", [[[(6.0, 46.0), (8.0, 46.0), (8.0, 48.0), (6.0, 48.0), (6.0, 46.0)]]])
    features = spark.createDataFrame([(1, json.dumps(box), {"v": "2"}), (2, json.dumps(("Point", [[[(9.0, 47.0)]]])), {"v": "3"})], "id long, geometry string, properties map<string, string>")
    g = Graph()
    s = g.add(Source(features, Grid(0.0, 90.0, 0.01), [Format("vector", crs=one_of(4326))]))
    wanted = Format("vector", crs=one_of(3857))
    even = g.add(Transform(lambda df, grid: vector.feature_filter(df, "v", 2), accepts=[wanted], makes=Format("vector"), passes=("crs", "chunk", "resolution")), s)
    burn = g.add(Transform(lambda df, grid: vector.rasterize(df, grid, "v"), accepts=[wanted], passes=("crs", "chunk", "resolution")), s)
    engine = g.build()
    assert engine.caps(even).crs == 3857 and engine.caps(even).kind == "vector" and len(engine.plan) == 5
    f = crs.transform(4326, 3857)
    low, high = f(7.0, 45.0), f(9.5, 47.0)
    window = Window(Bbox(*low, *high), engine.grid(even).base)
    row, = vector.measures(engine.pull(even, window, "vector")).collect()
    assert (row.id, row.min_x, row.max_y) == (1, pytest.approx(low[0]), pytest.approx(high[1]))
    assert row.max_x == pytest.approx(f(8.0, 46.0)[0]) and row.min_y == pytest.approx(f(8.0, 46.0)[1])
    with pytest.raises(E.KindError):
        engine.pull(even, window)
    near = Bbox(f(7.9, 46.4)[0], f(7.9, 46.4)[1], f(8.1, 46.6)[0], f(8.1, 46.6)[1])
    burnt = engine.pull(burn, Window(near, engine.grid(burn).base))
    assert 0 < burnt.count() and burnt.where("b0 <> 2").isEmpty()
    cloud = spark.createDataFrame([(float(i), 40.0 + i, 1.0, i) for i in range(10)], "x double, y double, z double, point_id long")
    g = Graph()
    s = g.add(Source(cloud, Grid(0.0, 60.0, 0.01), [Format("points", crs=one_of(4326))]))
    high_z = g.add(Transform(lambda df, grid: df.where("point_id <> 4"), accepts=[Format("points", crs=one_of(32632))], makes=Format("points"), passes=("crs", "chunk", "resolution")), s)
    engine = g.build()
    to = crs.transform(4326, 32632)
    (x0, y0), (x1, y1) = to(2.5, 42.5), to(6.5, 46.5)
    got = engine.pull(high_z, Window(Bbox(x0, y0, x1, y1), engine.grid(high_z).base), "points").orderBy("point_id").collect()
    assert [r.point_id for r in got] == [3, 5, 6] and (got[1].x, got[1].y) == (pytest.approx(to(5.0, 45.0)[0]), pytest.approx(to(5.0, 45.0)[1]))


LAYERS = """
[[layer]]
name = "index"
[layer.source]
type = "cog"
href = "x.tif"
[[layer.op]]
type = "bandmath"
expression = "b0 * 2"
min = 0.0
max = 100.0
[[layer.op]]
type = "slope"
"""


def test_layers(spark):
    spec, = layers.parse_layers(LAYERS)
    assert spec.gray == (0.0, 90.0)
    for bad in ("", LAYERS + LAYERS, LAYERS.replace("href", "hrefs"), LAYERS.replace('"index"', '"a b"'), LAYERS.replace("slope", "blur")):
        with pytest.raises(E.ComputeError):
            layers.parse_layers(bad)
    spec.ops = spec.ops[:1]
    c = cells(spark, [(x, y, 25.0) for x in range(64) for y in range(64)])
    x, y = crs.transform(4326, 3857)(7.0, 47.0)
    source = Source(c, Grid(7.0, 47.0, 0.01), [Format("raster", count=one_of(1), crs=one_of(4326))])
    z = 9
    tx, ty = int((x + 20037508.342789244) / (40075016.685578488 / 2**z)), int((20037508.342789244 - y) / (40075016.685578488 / 2**z))
    assert xyz_box(z, tx, ty).min_x <= x
    tile = layers.render_tile(spec, source, z, tx, ty)
    seen = {r.gray: r["count"] for r in tile.where("alpha = 255").groupBy("gray").count().collect()}
    assert set(seen) <= {127, 128} and tile.count() == 65536


def test_codecs(spark, tmp_path):
    bands = np.random.default_rng(1).random((2, 20, 30))
    bands[0, 3, 4] = np.nan
    body = codecs.write_geotiff(bands, 7.0, 47.0, 0.5, 4326)
    tiff = codecs.GeoTiff(body)
    assert (tiff.bands, tiff.epsg, tiff.x0, tiff.y0, tiff.size) == (2, 4326, 7.0, 47.0, 0.5)
    got = tiff.window(0, -2, -1, 40, 30)
    assert np.array_equal(got[:, 1:21, 2:32], bands, equal_nan=True) and np.isnan(got[:, 0]).all()
    (tmp_path / "a.tif").write_bytes(body)
    spark.dataSource.register(files.CogSource)
    cog = spark.read.format("cog").option("bands", 2).option("resolution", 1.0).option("bbox", "7,37,22,47").option("chunk", 8).load(str(tmp_path / "a.tif"))
    want = codecs.decimate(bands, 2)
    assert {(r.gx, r.gy): (r.b0, r.b1) for r in cog.collect()} == {(x, y): (want[0, y, x], want[1, y, x]) for x in range(15) for y in range(10)}
    assert files.read_geotiff(spark, str(tmp_path / "a.tif"), 2).count() == 600
    gray = np.arange(6, dtype=np.uint8).reshape(2, 3)
    back = codecs.read_png_gray(codecs.png_gray(gray, gray + 1))
    assert np.array_equal(back[0], gray) and np.array_equal(back[1], gray + 1)
    las = codecs.read_las(codecs.write_las([1.5, 2.25], [3, 4], [5, 6.001], [7, 8], [1, 2]))
    assert np.allclose(las["z"], [5, 6.001]) and las["classification"].tolist() == [1, 2]
    with pytest.raises(E.SourceError):
        codecs.read_las(codecs.write_las([], [], [], [], []))


SQUARE = ("Polygon", [[[(0.0, 0.0), (20.0, 0.0), (20.0, 10.0), (0.0, 10.0), (0.0, 0.0)], [(4.0, 4.0), (10.0, 4.0), (10.0, 6.0), (4.0, 6.0), (4.0, 4.0)]]])


def test_geometry():
    parts = [p for p in (G.clip(SQUARE, (x, y, x + 8, y + 8)) for x in (0, 8, 16) for y in (0, 8)) if p]
    whole = G.dissolve(parts)
    assert whole[0] == "Polygon" and len(whole[1][0]) == 2 and G.area(whole) == 188
    line = ("LineString", [[[(0.0, 8.0), (8.0, 8.0)]]])  # on an edge: one owner
    assert sum(G.clip(line, (0, y, 8, y + 8)) is not None for y in (0, 8)) == 1
    zigzag = ("LineString", [[[(-1.0, 1.0), (9.0, 1.0), (9.0, 2.0), (-1.0, 2.0)]]])
    assert len(G.clip(zigzag, (0, 0, 8, 8))[1]) == 2
    assert G.dissolve([G.clip(zigzag, b) for b in ((-8, 0, 0, 8), (0, 0, 8, 8), (8, 0, 16, 8))])[0] == "LineString"
    assert G.simplify(("LineString", [[[(0.0, 0.0), (5.0, 0.1), (10.0, 0.0)]]]), 1.0)[1] == [[[(0.0, 0.0), (10.0, 0.0)]]]
    assert G.simplify(("Polygon", [[[(0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.0)]]]), 1.0) is None


def test_overlay_of_any_polygons():
    """Stars with holes and rectangles that share corners and edges: areas add up, and points are within what they should be within."""
    random = np.random.default_rng(11)

    def star():
        x, y = random.uniform(-4, 4, 2)
        ring = [(x + r * math.cos(k * 0.7), y + r * math.sin(k * 0.7)) for k, r in enumerate(random.uniform(2, 6, 9))]
        ring.append(ring[0])
        return [ring, [(x + (u - x) / 5, y + (v - y) / 5) for u, v in ring]]

    def box():
        x, y, w, h = map(float, [*random.integers(-6, 5, 2), *random.integers(1, 7, 2)])
        return [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]

    def within(x, y, polygons):
        return G.inside(x, y, [r for rings in polygons for r in rings])

    for k in range(120):
        a, b = [(star, box)[k % 2]()], [(star, box)[k // 2 % 2]()]
        both, either = G.overlay(a, b, False), G.overlay(a, b, True)
        total = [G.area(("MultiPolygon", p)) for p in (both, either, a, b)]
        assert total[0] + total[1] == pytest.approx(total[2] + total[3], abs=1e-7)
        for x, y in random.uniform(-9, 9, (25, 2)):
            assert within(x, y, both) == (within(x, y, a) and within(x, y, b)) and within(x, y, either) == (within(x, y, a) or within(x, y, b))
    line = ("LineString", [[[(-1.0, 5.0), (21.0, 5.0)]]])  # through the hole of SQUARE
    assert G.clip_to(line, SQUARE[1]) == ("MultiLineString", [[[(0.0, 5.0), (4.0, 5.0)]], [[(10.0, 5.0), (20.0, 5.0)]]])
    points = ("MultiPoint", [[[(1.0, 1.0)]], [[(5.0, 5.0)]], [[(30.0, 1.0)]]])
    assert G.clip_to(points, SQUARE[1]) == ("MultiPoint", [[[(1.0, 1.0)]]])
    assert G.clip_to(SQUARE, [[[(30.0, 0.0), (40.0, 0.0), (40.0, 9.0), (30.0, 0.0)]]]) is None


def test_features(spark):
    text = '{"type":"FeatureCollection","features":[{"geometry":{"type":"Point","coordinates":[1,2]},"properties":{"a":3,"b":"x"}},{"geometry":null,"properties":{}},{"geometry":{"type":"LineString","coordinates":[[0,0],[3,4]]},"properties":{"a":3.0}}]}'
    f = vector.from_geojson(spark.createDataFrame([(text,)], "value string"))
    assert [r.id for r in f.orderBy("id").collect()] == [0, 1]
    ids = lambda k, v: sorted(r.id for r in vector.feature_filter(f, k, v).collect())
    assert ids("a", 3) == [0] and ids("a", 3.0) == [1] and ids("a", "3") == []
    assert vector.base_resolution(f) == 5.0
    p = vector.map_properties(f, {"a": "z"}, ["b"], {"k": 1}).orderBy("id").first()["properties"]
    assert p == {"z": "3", "k": "1"}
    burnt = {(r.gx, r.gy): r.b0 for r in vector.rasterize(f, Grid(0.0, 5.0, 1.0), "a").collect()}
    assert burnt[1, 3] == 3.0


def test_touching_fragments_do_not_spoil_a_union():
    box = ("Polygon", [[[(42.0, -6.0), (48.0, -6.0), (48.0, -10.0), (42.0, -10.0), (42.0, -6.0)]]])
    parts = [G.clip(box, b) for b in ((40, -8, 48, 0), (40, -16, 48, -8), (48, -8, 56, 0), (48, -16, 56, -8))]
    assert G.area(G.dissolve([p for p in parts if p])) == 24.0


def test_catalog(spark):
    pages = {"u0": {"features": [{"id": "a"}], "links": [{"rel": "self", "href": "u0"}, {"rel": "next", "href": "u1"}]}, "u1": {"features": [{"id": "b"}, {"id": "c"}]}, "loop": {"features": [], "links": [{"rel": "next", "href": "loop"}]}}
    fetch = lambda url: json.dumps(pages[url]).encode()
    assert [json.loads(r[0])["id"] for r in catalog.search(spark, fetch, "u0").collect()] == ["a", "b", "c"]
    with pytest.raises(E.PullTooLarge):
        catalog.search(spark, fetch, "u0", most=2)
    with pytest.raises(E.SourceError):
        catalog.search(spark, fetch, "loop")
    assert catalog.search_url("http://c/", "x", Bbox(1.0, 2.0, 3.0, 4.0)) == "http://c/search?collections=x&bbox=1.0,2.0,3.0,4.0&limit=100"
    assert catalog.stac_datetime(spark, Interval(0, 86400500)) == "1970-01-01T00:00:00Z/1970-01-02T00:00:00.500Z"
    assert catalog.blocks(Bbox(7.0, 45.0, 8.0, 46.0)) == (3, 3, 22, 22) and catalog.blocks(Bbox(7.9, 45.0, 8.1, 46.1)) == (3, 4, 22, 23)
    with pytest.raises(E.PullTooLarge):
        catalog.blocks(Bbox(0.0, 0.0, 60.0, 4.0))
    rows = [("a", "2024-01-01", ["h1", "x"], [1, 1], 32632), ("b", "2024-02-01", ["h1", "y"], [1, 1], 32632), ("c", "2024-03-01", ["h2", "z"], [2, 1], 32632), ("d", "2024-03-01", ["h3", "z"], [None, 1], 32632), ("e", "2024-04-01", ["h4", "z"], [1, 1], 0)]
    items = spark.createDataFrame(rows, "item_id string, datetime string, hrefs array<string>, counts array<int>, epsg int")
    assert sorted(r.item_id for r in composite.usable(items, [1, 1]).collect()) == ["b", "d"]
    boxes = spark.createDataFrame([("p", 6.0, 44.0, 9.0, 46.0, "2024-01-01"), ("q", 9.0, 44.0, 10.0, 46.0, "2024-01-01"), ("r", 6.0, 44.0, 9.0, 46.0, "2025-01-01")], "item_id string, min_x double, min_y double, max_x double, max_y double, datetime string")
    for table in (boxes, catalog.by_block(boxes)):
        got = catalog.intersecting(table, Bbox(8.0, 45.0, 9.0, 45.5), Interval(1704067200000, 1704067200001))
        assert [r.item_id for r in got.collect()] == ["p"]
    with pytest.raises(E.SourceError):
        catalog.opened(items.limit(0))


def test_tiles_listing_and_percentile(spark):
    spec = layers.parse_layers('[[layer]]\nname = "p"\n[layer.source]\ntype = "stac"\ncollection = "c"\nassets = ["a"]\ncomposite = "percentile"\npercentile = 50.0\n[[layer.op]]\ntype = "bandmath"\nexpression = "b0"\nmin = 0.0\nmax = 255.0\n')[0]
    stack = spark.createDataFrame([(f"i{k}", f"2024-01-0{k + 1}", x, y, float(10 * k + x)) for k in range(3) for x in range(40) for y in range(40)], "item_id string, datetime string, gx long, gy long, b0 double")
    source = Source(stack, Grid(7.0, 47.0, 0.01, 16), [Format("raster", crs=one_of(4326))], time_varying=True, composite="percentile", percentile=50.0)
    z, x, y = 9, 266, 180
    one = sorted(tuple(r) for r in layers.render_tile(spec, source, z, x, y).select("gx", "gy", "gray", "alpha").collect())
    many = layers.render_tiles(spec, source, z, [(x, y), (x + 1, y)])
    assert sorted(tuple(r) for r in many.where(f"x = {x} and y = {y}").select("gx", "gy", "gray", "alpha").collect()) == one
    assert many.count() == 2 * 65536 and any(r[3] == 255 for r in one)
    row = layers.listing(spark, [spec], {"p": source}).first()
    assert (row["name"], row.source, row.low, row.high) == ("p", "stac", 0.0, 255.0) and row.last_ms - row.first_ms == 2 * 86400000


def test_invalidation_on_the_graph(spark):
    base = cells(spark, [(gx, gy, 1.0) for gx in range(8) for gy in range(8)])
    g = Graph()
    a = g.add(Source(base, Grid(7.0, 47.0, 0.01, 16), [Format("raster", crs=one_of(4326))]))
    b = g.add(Transform(lambda c, grid: c, halo=2), a)
    c = g.add(Reproject(3857), b)
    engine, told = g.build(), []
    engine.subscribe(told.append)
    out = engine.invalidate(a, Bbox(7.02, 46.95, 7.03, 46.96))
    assert out == told and [x.node for x in out] == [str(a), str(b), str(c)]
    assert out[1].bbox.min_x == pytest.approx(7.0) and out[1].bbox.max_y == pytest.approx(46.98)
    assert out[2].bbox.min_x < 7.0 * 111319.4907 and out[2].bbox.max_x > 7.05 * 111319.4907


def test_ids_of_several_collections(spark):
    point = lambda x: '{"geometry":{"type":"Point","coordinates":[%d,0]},"properties":{}}' % x
    texts = [("b", '{"features":[%s,%s]}' % (point(3), point(4))), ("a", '{"features":[%s,{"geometry":null},%s,%s]}' % (point(0), point(1), point(2)))]
    f = vector.from_geojson(spark.createDataFrame(texts, "path string, value string"))
    assert [(r.id, json.loads(r.geometry)[1][0][0][0][0]) for r in f.orderBy("id").collect()] == [(i, float(i)) for i in range(5)]


def test_points(spark):
    rows = [(x + 0.5, y + 0.5, 42.0, x * 8 + y) for x in range(8) for y in range(8)]
    p = spark.createDataFrame(rows, "x double, y double, z double, point_id long")
    assert points.voxel_thin(p, 4.0).count() == 4
    grid = Grid(0.0, 8.0, 1.0)
    assert {r.b0 for r in points.idw(p, grid, radius_px=2.0).where("gx between 0 and 7").collect()} == {42.0}
    with pytest.raises(E.SourceError):
        points.cloud_grid(p.limit(0))


def test_live(spark, tmp_path):
    grid = Grid(0.0, 0.0, 1.0, 4)
    base = cells(spark, [(x, y, 1.0) for x in range(16) for y in range(16)])
    table = live.TileTable(spark, str(tmp_path / "tiles"), grid)
    table.store(base)
    told = []
    src = tmp_path / "in"
    src.mkdir()
    changes = spark.readStream.schema("min_x double, min_y double, max_x double, max_y double").json(str(src))
    query = live.follow(changes, table, lambda box: raster.window(base, grid, box).withColumn("b0", F.col("b0") + 1), str(tmp_path / "cp"), told.append)
    (src / "a.json").write_text('{"min_x": 4.5, "min_y": -7, "max_x": 6, "max_y": -5}')
    query.processAllAvailable()
    query.stop()
    spark.catalog.refreshByPath(str(tmp_path / "tiles"))
    got = {r.b0: r["count"] for r in table.read().groupBy("b0").count().collect()}
    assert got == {1.0: 240, 2.0: 16} and told == [Bbox(4.5, -7, 6, -5)]
    # A tile that has no pixel any more is emptied.
    assert table.refresh(Bbox(8.5, -3, 9, -1), lambda box: raster.window(base, grid, box).limit(0)) == 1
    spark.catalog.refreshByPath(str(tmp_path / "tiles"))
    assert table.read().count() == 240 and table.read().where("gx between 8 and 11 and gy between 0 and 3").isEmpty()
    out = live.spread_downstream({"src": [("shade", 1.0), ("mix", 0.0)], "shade": [("mix", 0.0)]}, "src", Bbox(0, 0, 1, 1))
    assert [x.node for x in out][0] == "src" and out[-1].bbox == Bbox(-1, -1, 2, 2)
