"""Graphs of sources and operators. Building one settles every link's format (reprojections are put in where CRSs differ) and composes a
lazy DataFrame; pulling a window only adds filters, widened by each operator's halo, which Catalyst takes down to the scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..errors import EmptyLink, InvalidGraph, KindError
from ..functions import crs
from ..functions.grid import Bbox, Grid, Window
from ..operators import composite, points, raster, resample, vector
from ..streaming.live import Invalidation
from .caps import Choice, Format, Settled, link, one_of, through


@dataclass
class Source:
    """cells: base cells with gx, gy, b0..; with a stack (datetime) it varies in time and is composed per pull. A source of vectors holds
    features, one of points a cloud; its grid then only names the resolution of its levels."""

    cells: DataFrame
    grid: Grid
    formats: list[Format]
    time_varying: bool = False
    composite: str = "latest"
    percentile: float | None = None


@dataclass
class Transform:
    """apply(cells, grid) -> cells. accepts: formats of the input; passes: fields that the output keeps; makes: the rest."""

    apply: Callable[[DataFrame, Grid], DataFrame]
    accepts: list[Format] = field(default_factory=lambda: [Format("raster")])
    makes: Format = field(default_factory=lambda: Format("raster"))
    passes: tuple[str, ...] = ("dtype", "count", "crs", "chunk", "resolution")
    halo: int = 0


@dataclass
class Fanin:
    """apply(inputs, grid) -> cells, all inputs sampled onto the finest input grid."""

    apply: Callable[[list[DataFrame], Grid], DataFrame]
    accepts: list[Format] = field(default_factory=lambda: [Format("raster")])
    inputs: int | None = None


@dataclass
class Reproject:
    target: int


class Graph:
    def __init__(self):
        self.nodes: list[tuple[object, list[int]]] = []
        self.adapters: list[Callable[[Format, Format], object | None]] = []

    def add(self, node, *parents: int) -> int:
        if any(p >= len(self.nodes) for p in parents):
            raise InvalidGraph("unknown parent")
        if isinstance(node, Fanin) and (len(parents) < 2 or node.inputs not in (None, len(parents))):
            raise InvalidGraph(f"a fan-in takes {node.inputs or 'two or more'} inputs, {len(parents)} given")
        if isinstance(node, Source) != (not parents) or not isinstance(node, (Source, Fanin)) and len(parents) != 1:
            raise InvalidGraph("wrong number of inputs")
        self.nodes.append((node, list(parents)))
        return len(self.nodes) - 1

    def register_adapter(self, make: Callable[[Format, Format], object | None]) -> None:
        """make(made, wanted) -> a node to put between, or None; tried in order before the built-in reprojection."""
        self.adapters.append(make)

    def _adapter(self, made: list[Format], wanted: list[Format]):
        for a in made:
            for b in wanted:
                for make in self.adapters:
                    if (node := make(a, b)) is not None:
                        return node
                if a.kind == b.kind and a.crs.meet(b.crs) is None and b.crs.values:
                    return Reproject(b.crs.values[0])
        return None

    def build(self) -> Engine:
        formats: list[list[Format]] = []
        plan: list[tuple[object, list[int]]] = []
        place: dict[int, int] = {}

        def put(node, parents: list[int]) -> int:
            wanted = getattr(node, "accepts", None)
            if isinstance(node, Source):
                out = node.formats
            else:
                linked = []
                for k, p in enumerate(parents):
                    want = wanted or [Format(formats[p][0].kind)]
                    if isinstance(node, Fanin) and k:
                        want = [replace(w, crs=linked[0][0].crs if w.crs == Choice() else w.crs) for w in want]
                    for _ in range(3):
                        try:
                            linked.append(link(formats[p], want, f"nodes {p} and {len(plan)}"))
                            break
                        except EmptyLink:
                            between = self._adapter(formats[p], want)
                            if between is None:
                                raise
                            p = put(between, [p])
                            parents[k] = p
                    else:
                        raise EmptyLink(f"no adapter helps before node {len(plan)}")
                if isinstance(node, Reproject):
                    out = [replace(f, crs=one_of(node.target), resolution=(0.0, float("inf"))) for f in linked[0]]
                elif isinstance(node, Fanin):
                    out = linked[0]
                else:
                    out = through(linked[0], node.passes, node.makes)
            plan.append((node, parents))
            formats.append(out)
            return len(plan) - 1

        for i, (node, parents) in enumerate(self.nodes):
            place[i] = put(node, [place[p] for p in parents])
        settled = [f[0].settled() for f in formats]
        return Engine(plan, settled, place)


class Engine:
    def __init__(self, plan, caps: list[Settled], place: dict[int, int]):
        self.plan, self._caps, self.place = plan, caps, place
        self.grids: list[Grid] = []
        self.told: list[Callable[[Invalidation], None]] = []
        self.varying: list[bool] = []
        for i, (node, parents) in enumerate(plan):
            self.varying.append(getattr(node, "time_varying", False) or any(self.varying[p] for p in parents))
            if isinstance(node, Source):
                grid = node.grid
            elif isinstance(node, Reproject):
                grid = resample.output_grid(self.grids[parents[0]], caps[parents[0]].crs, node.target)
            elif isinstance(node, Fanin):
                grid = min((self.grids[p] for p in parents), key=lambda g: g.base)
            else:
                grid = self.grids[parents[0]]
            self.grids.append(replace(grid, chunk=caps[i].chunk))

    def caps(self, node: int) -> Settled:
        return self._caps[self.place[node]]

    def grid(self, node: int) -> Grid:
        return self.grids[self.place[node]]

    def subscribe(self, told: Callable[[Invalidation], None]) -> None:
        """told is called with every node that a dirty window reaches."""
        self.told.append(told)

    def invalidate(self, node: int, box: Bbox) -> list[Invalidation]:
        """The dirty window of each node that depends on a changed window, in order from the changed node: a reprojection turns it into
        its CRS, a halo widens it, and at a fan-in the windows of the inputs are united."""
        at = {i: n for n, i in self.place.items()}
        dirty: dict[int, Bbox] = {self.place[node]: box}
        for i, (step, parents) in enumerate(self.plan):
            reached = [dirty[p] for p in parents if p in dirty]
            if not reached or i in dirty:
                continue
            if isinstance(step, Reproject):
                reached = [crs.envelope(reached[0], self._caps[parents[0]].crs, step.target)]
            r = self.grids[i].base * (step.halo if isinstance(step, Transform) else 1)
            dirty[i] = Bbox(min(b.min_x for b in reached), min(b.min_y for b in reached), max(b.max_x for b in reached), max(b.max_y for b in reached)).expand(r)
        out = [Invalidation(str(at[i]), b) for i, b in sorted(dirty.items()) if i in at]
        for x in out:
            for told in self.told:
                told(x)
        return out

    def pull(self, node: int, window: Window, kind: str = "raster") -> DataFrame:
        """Cells of a window at the level for its resolution; of vectors the parts of features in the window, of points those in it, both
        thinned above level 0."""
        i = self.place[node]
        if self._caps[i].kind != kind:
            raise KindError(f"node {node} gives {self._caps[i].kind}, not {kind}")
        level = self.grids[i].level_for(window.resolution)
        self.grids[i].tiles(window.bbox, level)
        return self._crop(i, self._cells(i, window.bbox, level, window), window.bbox, level)

    def _crop(self, i: int, df: DataFrame, box: Bbox, level: int) -> DataFrame:
        kind = self._caps[i].kind
        if kind == "vector":
            return vector.crop(df, box)
        return points.in_window(df, box) if kind == "points" else raster.window(df, self.grids[i], box, level)

    def _features(self, i: int, box: Bbox, level: int) -> DataFrame:
        """What a source of vectors or points holds in a window."""
        node, grid = self.plan[i][0], self.grids[i]
        if self._caps[i].kind == "points":
            return points.read_points(node.cells, grid, box, level)
        return vector.crop(vector.simplify(node.cells, grid.resolution(level)) if level else node.cells, box)

    def _moved(self, i: int, p: int, box: Bbox, level: int, window: Window) -> DataFrame:
        """Vectors or points of a node in another CRS; a window is taken a little wide, since its edges bend, and cut to size afterwards."""
        source, target = self._caps[p].crs, self._caps[i].crs
        near = crs.envelope(box, target, source)
        up = self.grids[p].level_for(self.grids[p].base * 2**level)
        df = self._cells(p, near.expand(max(near.max_x - near.min_x, near.max_y - near.min_y) / 64), up, window)
        if self._caps[i].kind == "vector":
            return vector.reproject(df, source, target, box)
        x, y = crs.transform(source, target, columns=True)(df.x, df.y)
        return points.in_window(df.withColumns({"x": x, "y": y}), box)

    def _cells(self, i: int, box: Bbox, level: int, window: Window) -> DataFrame:
        node, parents = self.plan[i]
        grid = self.grids[i]
        kind = self._caps[i].kind
        if isinstance(node, Source) and kind in ("vector", "points"):
            return self._features(i, box, level)
        if isinstance(node, Reproject) and kind in ("vector", "points"):
            return self._moved(i, parents[0], box, level, window)
        if isinstance(node, Source):
            gx0, gx1, gy0, gy1 = grid.aligned(box, level)
            base = node.cells.where((node.cells.gx >= gx0 << level) & (node.cells.gx < gx1 + 1 << level) & (node.cells.gy >= gy0 << level) & (node.cells.gy < gy1 + 1 << level))
            if node.time_varying:
                base = composite.composite(base, node.composite, node.percentile, window.time)
            return raster.coarsen(base, level) if level else base
        if isinstance(node, Reproject):
            p = parents[0]
            near = crs.envelope(box, node.target, self._caps[p].crs)
            up = self.grids[p].level_for(self.grids[p].base * 2**level)
            source = self.grids[p].coarser(up)
            cells = self._cells(p, near.expand(2 * source.base), up, window)
            return resample.reproject(cells, source, self._caps[p].crs, grid.coarser(level), node.target, box)
        if isinstance(node, Fanin):
            parts = []
            for p in parents:
                own = self.grids[p]
                up = own.level_for(grid.resolution(level))
                cells = self._cells(p, box.expand(2 * own.resolution(up)), up, window)
                if kind in ("vector", "points"):
                    parts.append(self._crop(p, cells, box, up))
                    continue
                same = abs(own.resolution(up) - grid.resolution(level)) < 1e-12 * grid.base and (own.x0, own.y0) == (grid.x0, grid.y0)
                parts.append(cells if same else resample.resample(cells, own.coarser(up), grid.coarser(level), box))
            return node.apply(parts, grid.coarser(level))
        cells = self._cells(parents[0], box.expand(node.halo * grid.resolution(level)), level, window)
        return node.apply(cells, grid.coarser(level))
