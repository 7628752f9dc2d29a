"""Features: id, geometry (JSON text of ["type", parts]), properties (a map of JSON texts). Geometry runs in Arrow batches."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SourceError
from ..functions import crs
from ..functions import geometry as G
from ..functions.grid import Bbox, Grid

EPSILON = 2.220446049250313e-16


def _geometry(text: str):
    def rebuild(g):
        kind, parts = g
        return kind, [rebuild(p) for p in parts] if kind == "GeometryCollection" else [[[tuple(c) for c in line] for line in part] for part in parts]

    return rebuild(json.loads(text))


def map_geometry(features: DataFrame, f) -> DataFrame:
    """f(geometry, row of the other columns) -> geometry or None (the feature is dropped); other columns stay."""
    names = features.columns

    def run(batches):
        for batch in batches:
            rows, keep = batch.to_pylist(), []
            out = []
            for i, row in enumerate(rows):
                g = f(_geometry(row["geometry"]), row)
                if g is not None:
                    keep.append(i)
                    out.append(json.dumps(g))
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "geometry" else part.column(c) for c in names], names)

    return features.mapInArrow(run, features.schema)


def from_geojson(text: DataFrame) -> DataFrame:
    """Features of FeatureCollections in a `value` column, ids 0.. over those that have a geometry: in their order within a collection,
    and collections in the order of `path` (or of their text, where there is no such column). Only one row a collection is ordered."""
    feature = "struct<geometry: string, properties: map<string, string>>"
    found = F.filter(F.from_json("value", f"struct<features: array<{feature}>>")["features"], lambda f: f["geometry"].isNotNull())
    key = F.col("path") if "path" in text.columns else F.sha2("value", 256)
    held = text.select(key.alias("file"), found.alias("found")).where(F.size("found") > 0)
    # Equal collections without a path share a key and then take turns.
    counts = held.groupBy("file").agg(F.count("*").alias("copies"), F.max(F.size("found")).alias("n"))
    first = F.coalesce(F.sum(F.col("copies") * F.col("n")).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turn = F.row_number().over(Window.partitionBy("file").orderBy(F.lit(0))) - 1
    numbered = held.withColumn("turn", turn).join(counts.select("file", "n", first.alias("first")), "file")
    rows = numbered.select((F.col("first") + F.col("turn") * F.col("n")).alias("base"), F.posexplode("found").alias("at", "f"))
    placed = rows.select((F.col("base") + F.col("at")).cast("long").alias("id"), F.col("f.geometry").alias("raw"), F.col("f.properties").alias("properties"))

    def run(batches):
        for batch in batches:
            geoms = [json.dumps(parse_geojson(json.loads(x))) for x in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(geoms, pa.string()), batch.column("properties")], ["id", "geometry", "properties"])

    return placed.mapInArrow(run, "id long, geometry string, properties map<string, string>")


def measures(features: DataFrame) -> DataFrame:
    """id, area, envelope and number of positions of each geometry."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("geometry").to_pylist(), strict=True):
                g = _geometry(text)
                rows.append((i, float(G.area(g)), *map(float, G.envelope(g)), len(list(G.coordinates(g)))))
            names = ["id", "area", "min_x", "min_y", "max_x", "max_y", "positions"]
            kinds = [pa.int64(), *[pa.float64()] * 5, pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return features.select("id", "geometry").mapInArrow(run, "id long, area double, min_x double, min_y double, max_x double, max_y double, positions long")


def parse_geojson(g: dict):
    kind, c = g["type"], g.get("coordinates")
    xy = lambda p: (float(p[0]), float(p[1]))
    line = lambda q: [xy(p) for p in q]
    if kind == "GeometryCollection":
        return kind, [parse_geojson(x) for x in g["geometries"]]
    if kind == "Point":
        return kind, [[[xy(c)]]]
    if kind == "MultiPoint":
        return kind, [[[xy(p)]] for p in c]
    if kind == "LineString":
        return kind, [[line(c)]]
    if kind == "MultiLineString":
        return kind, [[line(q)] for q in c]
    if kind == "Polygon":
        return kind, [[line(r) for r in c]]
    if kind == "MultiPolygon":
        return kind, [[line(r) for r in p] for p in c]
    raise SourceError(f"unknown geometry {kind!r}")


def feature_filter(features: DataFrame, field: str, equals) -> DataFrame:
    """Features whose property equals a string, bool, int or float. Text and truth match exactly; a whole number only whole numbers, and
    other numbers within an epsilon only numbers that aren't whole; missing or other types drop the feature."""
    raw = F.trim(F.col("properties")[field])
    kind = F.schema_of_variant(F.try_parse_json(raw))
    value = F.try_parse_json(raw)
    if isinstance(equals, bool):
        hit = (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == equals)
    elif isinstance(equals, str):
        hit = (kind == "STRING") & (F.try_variant_get(value, "$", "string") == equals)
    elif isinstance(equals, int):
        hit = (kind == "BIGINT") & (F.try_variant_get(value, "$", "bigint") == equals)
    else:
        hit = (kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (F.abs(F.try_variant_get(value, "$", "double") - float(equals)) <= EPSILON)
    return features.where(F.coalesce(hit, F.lit(False)))


def map_properties(features: DataFrame, rename: dict[str, str] | None = None, drop: list[str] | None = None, add: dict[str, object] | None = None) -> DataFrame:
    """Drops properties by their old names, renames the rest, and adds defaults where a name is then absent. Of keys that are renamed
    alike, the one that sorts last wins."""
    p = F.col("properties")
    if drop:
        p = F.map_filter(p, lambda k, _: ~k.isin(drop))
    entries = F.array_sort(F.map_entries(p))
    names = F.transform(entries, lambda e: e["key"])
    values = F.transform(entries, lambda e: e["value"])
    if rename:
        table = F.create_map(*[F.lit(x) for kv in rename.items() for x in kv])
        names = F.transform(names, lambda k: F.coalesce(F.element_at(table, k), k))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    # Later keys win: an entry stays if its name doesn't come again.
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(names, i + 2, F.size(names)), lambda k: k == e["k"]))
    out = F.map_from_entries(last)
    for k, v in (add or {}).items():
        out = F.when(F.map_contains_key(out, k), out).otherwise(F.map_concat(out, F.create_map(F.lit(k), F.lit(json.dumps(v)))))
    return features.withColumn("properties", out)


def tiled(features: DataFrame, grid: Grid, level: int, box: Bbox) -> DataFrame:
    """Fragments of a window: features that touch it, thinned above level 0, once for each tile and clipped to it."""
    r, size = grid.resolution(level), grid.resolution(level) * grid.chunk
    ix0, ix1, iy0, iy1 = grid.tiles(box, level)
    names = features.columns

    def run(batches):
        for batch in batches:
            take, ixs, iys, geoms = [], [], [], []
            for i, row in enumerate(batch.to_pylist()):
                g = _geometry(row["geometry"])
                g = G.simplify(g, r) if level else g
                if g is None:
                    continue
                x0, y0, x1, y1 = G.envelope(g)
                for ix in range(max(ix0, int((x0 - grid.x0) // size)), min(ix1, int((x1 - grid.x0) // size)) + 1):
                    for iy in range(max(iy0, int((grid.y0 - y1) // size)), min(iy1, int((grid.y0 - y0) // size)) + 1):
                        t = grid.tile_box(level, ix, iy)
                        part = G.clip(g, (t.min_x, t.min_y, t.max_x, t.max_y))
                        if part:
                            take.append(i), ixs.append(ix), iys.append(iy), geoms.append(json.dumps(part))
            rest = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(geoms, pa.string()) if c == "geometry" else rest.column(c) for c in names] + [pa.array(ixs, pa.int64()), pa.array(iys, pa.int64())], [*names, "ix", "iy"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*features.schema.fields, StructField("ix", LongType()), StructField("iy", LongType())])
    return features.mapInArrow(run, schema)


def clip_to(features: DataFrame, boundary: list) -> DataFrame:
    """Features within a boundary: one ring, or the polygons (lists of rings) of a multipolygon of any shape."""
    polygons = [[boundary]] if isinstance(boundary[0][0], (int, float)) else boundary
    return map_geometry(features, lambda g, _: G.clip_to(g, polygons))


def simplify(features: DataFrame, resolution: float) -> DataFrame:
    return map_geometry(features, lambda g, _: G.simplify(g, resolution))


def reproject(features: DataFrame, source: int, target: int, box: Bbox | None = None) -> DataFrame:
    """Every vertex projected; edges stay straight. box: a window in the target's CRS, to which the result is clipped."""
    f = crs.transform(source, target)

    def move(g):
        kind, parts = g
        return kind, [move(p) for p in parts] if kind == "GeometryCollection" else [[[f(*c) for c in line] for line in part] for part in parts]

    edges = box and (box.min_x, box.min_y, box.max_x, box.max_y)
    return map_geometry(features, lambda g, _: G.clip(move(g), edges) if edges else move(g))


def crop(features: DataFrame, box: Bbox) -> DataFrame:
    """The parts of features within a window."""
    return map_geometry(features, lambda g, _: G.clip(g, (box.min_x, box.min_y, box.max_x, box.max_y)))


def fragments_in_order(fragments: DataFrame) -> DataFrame:
    """Fragments by feature, and within a feature by tile."""
    return fragments.orderBy("id", "iy", "ix")


def dissolve(fragments: DataFrame) -> DataFrame:
    """One feature an id: fragments united by class; the properties of the first fragment (by tile)."""
    order = F.struct("iy", "ix") if {"ix", "iy"} <= set(fragments.columns) else F.col("geometry")
    grouped = fragments.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("geometry").alias("g")))).alias("parts"), F.min_by(F.to_json("properties"), order).alias("p"))

    def run(batches):
        for batch in batches:
            geoms = [json.dumps(G.dissolve([_geometry(x["g"]) for x in parts])) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(geoms, pa.string()), batch.column("p")], ["id", "geometry", "p"])

    out = grouped.select("id", "parts", "p").mapInArrow(run, "id long, geometry string, p string")
    return out.select("id", "geometry", F.from_json("p", "map<string, string>").alias("properties"))


def base_resolution(features: DataFrame) -> float:
    """The upper median of positive segment lengths, else a 1024th of the larger side, else 1."""

    def run(batches):
        for batch in batches:
            for text in batch.column("geometry").to_pylist():
                g = _geometry(text)
                x0, y0, x1, y1 = G.envelope(g)
                d = list(G.segment_lengths(g))
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.list_(pa.float64())), *[pa.array([v]) for v in (x0, y0, x1, y1)]], ["d", "x0", "y0", "x1", "y1"])

    facts = features.select("geometry").mapInArrow(run, "d array<double>, x0 double, y0 double, x1 double, y1 double")
    lengths = facts.select(F.explode("d").alias("d"))
    n = lengths.count()
    row = facts.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    if row[0] is None:
        raise SourceError("the collection has no features")
    if n:
        # Exact, without a sort of all lengths in one task: the n div 2-th of an ordered, indexed RDD would be; percentile_disc counts values.
        return lengths.agg(F.expr(f"percentile_disc({(n // 2 + 1) / n}) within group (order by d)")).first()[0]
    side = max(row[2] - row[0], row[3] - row[1])
    return side / 1024 if side > 0 else 1.0


def rasterize(features: DataFrame, grid: Grid, burn: float | str, level: int = 0) -> DataFrame:
    """gx, gy, b0: pixels whose centre a polygon covers, that a line passes or a point falls in; the last feature (by id) wins.

    burn: a number, or the name of a numeric property (features without it are skipped).
    """
    r = grid.resolution(level)

    def run(batches):
        for batch in batches:
            ids, gxs, gys, values = [], [], [], []
            for row in batch.to_pylist():
                v = burn
                if isinstance(burn, str):
                    try:
                        v = json.loads((row["properties"] or {})[burn] if isinstance(row["properties"], dict) else dict(row["properties"])[burn])
                    except (KeyError, ValueError, TypeError):
                        continue
                    if isinstance(v, bool) or not isinstance(v, (int, float)):
                        continue
                for kind, parts in G.members(_geometry(row["geometry"])):
                    cells: set = set()
                    for part in parts:
                        if kind.endswith("Point"):
                            cells.add((int((part[0][0][0] - grid.x0) // r), int((grid.y0 - part[0][0][1]) // r)))
                        elif kind.endswith("LineString"):
                            for line in part:
                                cells.update(G.line_cells(line, grid.x0, grid.y0, r))
                        else:
                            x0, y0, x1, y1 = G.envelope((kind, [part]))
                            for gy in range(int((grid.y0 - y1) // r), int((grid.y0 - y0) // r) + 1):
                                for gx in range(int((x0 - grid.x0) // r), int((x1 - grid.x0) // r) + 1):
                                    if G.inside(grid.x0 + (gx + 0.5) * r, grid.y0 - (gy + 0.5) * r, part):
                                        cells.add((gx, gy))
                    for gx, gy in sorted(cells):
                        ids.append(row["id"]), gxs.append(gx), gys.append(gy), values.append(float(v))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(gxs, pa.int64()), pa.array(gys, pa.int64()), pa.array(values, pa.float64())], ["id", "gx", "gy", "v"])

    hits = features.select("id", "geometry", "properties").mapInArrow(run, "id long, gx long, gy long, v double")
    return hits.groupBy("gx", "gy").agg(F.max_by("v", "id").alias("b0"))
