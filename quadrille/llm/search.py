"""Exact top-k inner-product search by pivot tables: bounds from distances to many pivots, candidates in bound order until none can win."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import save

PIVOTS = 32
PIVOT_SAMPLE = 2000
#: Candidates of a task, about; of a block within it; queries that a pass over the candidates answers, about.
CANDIDATES, BLOCK, QUERY_BLOCK = 8192, 512, 2048
#: In a block, candidates are evaluated in bound order in steps: so many a query, then so many, then the rest.
STEPS = (16, 112)
#: Where more than this share of what is left of a block is open, it is multiplied as matrices.
DENSE = 0.25


def scaled(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 1024).cast("double"))


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and the scaled vector of the rows that take part: none null, no component null or not finite."""
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("v"))


def padded(rows: list, width: int) -> np.ndarray:
    x = np.zeros((len(rows), max([width, *map(len, rows)])))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x


def sampled(vectors: DataFrame, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """A bounded sample by the ids' hash. It gives pivots and first thresholds, which set how much is skipped and never what is found."""
    return padded([r[0] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(sample).collect()], 0)


def choose_pivots(x: np.ndarray, m: int = PIVOTS) -> np.ndarray:
    """m of the vectors, far from each other."""
    if not len(x):
        return np.zeros((0, 0))
    chosen, gap = [0], np.full(len(x), np.inf)
    while len(chosen) < min(m, len(x)):
        gap = np.minimum(gap, np.linalg.norm(x - x[chosen[-1]], axis=1))
        chosen.append(int(gap.argmax()))
    return x[chosen]


def near_pivots(vectors: DataFrame, pivot: np.ndarray) -> DataFrame:
    """vec_id, v, and the nearest pivot (cell) with its distance (near)."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("v"), pivot.shape[1])
            table = away(x, np.pad(pivot, ((0, 0), (0, x.shape[1] - pivot.shape[1])))) if len(pivot) else np.zeros((len(x), 1))
            cell = table.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(table[np.arange(len(x)), cell])], ["vec_id", "v", "cell", "near"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, cell int, near double")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones are padded with 0."""
    flat, long = np.asarray(column.flatten()), np.diff(np.asarray(column.offsets))
    out = np.zeros((len(long), max(width, int(long.max(initial=0)))))
    row = np.repeat(np.arange(len(long)), long)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(long) - long, long)] = flat
    return out


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, row by row. Doubles are exact below 2**53; beyond, whole Python numbers, cut to the range of a long."""
    if len(x) and np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1] < 2**53:
        return np.rint(np.einsum("ij,ij->i", x, q)).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(x.tolist(), q.tolist(), strict=True)]
    return np.array([max(-(2**63), min(2**63 - 1, v)) for v in whole], np.int64)


def away(x: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Distances of vectors to the pivots."""
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivot, pivot)[None, :] - 2 * (x @ pivot.T)
    return np.sqrt(np.maximum(square, 0.0))


class Pivots:
    """Upper bounds of inner products from tables of distances to pivots.

    <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2. For a block, |q - x| is at least the gap between the query's distance to a pivot and the
    range of the block's; the widest gap counts. For a single candidate, its distances to all pivots together fix its projection on
    their span, and the parts beyond the span meet in no more than the product of their lengths.
    """

    def __init__(self, pivot: np.ndarray):
        self.pivot = pivot
        u, size, basis = np.linalg.svd(pivot, full_matrices=False) if pivot.size else (None, np.zeros(0), np.zeros((0, pivot.shape[1])))
        self.basis = basis[size > 1e-9 * max(1.0, size.max(initial=0.0))]

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Squared lengths, projections, and lengths beyond the span."""
        norm, inner = np.einsum("ij,ij->i", x, x), x @ self.basis.T
        return norm, inner, np.sqrt(np.maximum(norm - np.einsum("ij,ij->i", inner, inner), 0.0))

    def block_bounds(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For each query, a bound of its scores in one block: by rings around the pivots, and by the block's centre and radius."""
        rings, near = away(x, self.pivot), away(q, self.pivot)
        gap = np.maximum(np.maximum(rings.min(0) - near, near - rings.max(0)), 0.0).max(1, initial=0.0) if self.pivot.size else np.zeros(len(q))
        norm_x, norm_q, centre = np.einsum("ij,ij->i", x, x).max(), np.einsum("ij,ij->i", q, q), x.mean(0)
        radius = np.sqrt(np.einsum("ij,ij->i", x - centre, x - centre).max())
        slack = 1e-9 * (norm_q + norm_x) + 1.0
        return np.minimum((norm_q + norm_x - gap**2) / 2, q @ centre + np.sqrt(norm_q) * radius) + slack

    def bounds(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """A bound for each candidate (rows) and query (columns)."""
        (nx, px, rx), (nq, pq, rq) = self.parts(x), self.parts(q)
        return px @ pq.T + rx[:, None] * rq[None, :] + 1e-9 * (nx[:, None] + nq[None, :]) + 1.0


class Best:
    """The `most` best candidates of each query so far (ties to the smaller vec_id), and the score that a further one must reach."""

    def __init__(self, queries: int, most: int, least: np.ndarray):
        self.most, self.least = most, least.astype(np.float64)
        self.query, self.ids, self.score, self.own = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray, own: np.ndarray) -> None:
        query, ids, score, own = np.r_[self.query, query], np.r_[self.ids, ids], np.r_[self.score, score], np.r_[self.own, own]
        order = np.lexsort((ids, -score, query))
        query = query[order]
        first = np.searchsorted(query, np.arange(len(self.least)))
        place = np.arange(len(query)) - first[query]
        full = order[place == self.most - 1]
        np.maximum.at(self.least, query[place == self.most - 1], score[full].astype(np.float64))
        keep = order[place < self.most]
        self.query, self.ids, self.score, self.own = query[place < self.most], ids[keep], score[keep], own[keep]


def search_block(pivots: Pivots, x: np.ndarray, ids: np.ndarray, q: np.ndarray, query_ids: np.ndarray, best: Best) -> int:
    """Takes a block's candidates into best, in bound order until none that is left can enter; the number of scores made."""
    live = np.flatnonzero(pivots.block_bounds(x, q) >= best.least)
    if not len(live):
        return 0
    bound, scored = pivots.bounds(x, q[live]), 0
    order = np.argsort(-bound, axis=0, kind="stable")
    cuts = [0, *[c for c in np.cumsum(STEPS) if c < len(x)], len(x)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rest = np.take_along_axis(bound, order[a:], 0) >= best.least[live]
        if not rest.any():
            break
        dense = rest.mean() > DENSE and np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1] < 2**53
        open_ = rest if dense else rest[: b - a]
        row, col = order[a : a + len(open_)][open_], np.nonzero(open_)[1]
        if dense:
            asked = np.unique(col)
            score = np.rint(x @ q[live[asked]].T).astype(np.int64)[row, np.searchsorted(asked, col)]
            scored += len(x) * len(asked)
        else:
            score = np.concatenate([exact_scores(x[row[i : i + 65_536]], q[live[col[i : i + 65_536]]]) for i in range(0, max(1, len(row)), 65_536)])
            scored += len(row)
        good = np.flatnonzero(score >= best.least[live[col]])
        row, query = row[good], live[col[good]]
        same = ids[row] == query_ids[query]
        same[same] = (x[row[same]] == q[query[same]]).all(1)
        best.add(query, ids[row], score[good], same.astype(np.int64))
        if dense:
            break
    return scored


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, every: int = 100, pivots: int = PIVOTS, told: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query by integer inner product, ties to the smaller vec_id.

    vectors: vec_id, embedding; other columns are ignored. Queries are the rows whose id is divisible by `every` unless given (same
    columns). Candidates lie sorted by their nearest pivot; each pass over them answers a bounded block of queries, which alone is
    broadcast, and no candidate is copied. A query doesn't find its own row, of which it takes one away if several are equal; other rows
    of its id are candidates. Each row that is a query gets its own result rows, also where rows share a vec_id. Vectors of different
    lengths meet over their common components. Null vectors, or such with null or non-finite components, take no part. Fewer candidates
    than k give fewer rows, an empty table none. told: takes `pairs` and `scored`, the numbers of all pairs and of scores made.
    """
    spark = vectors.sparkSession
    base = whole_vectors(vectors)
    sample = sampled(base)
    pivot = choose_pivots(sample, pivots)
    asks = (whole_vectors(queries) if queries is not None else base.where(F.col("vec_id") % every == 0)).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    asks = save(asks, "queries")
    n, asked = base.count(), asks.count()
    blocks = max(1, -(-asked // QUERY_BLOCK))
    placed = save(near_pivots(base, pivot).repartitionByRange(max(1, -(-n // CANDIDATES)), "cell", "near", F.xxhash64("vec_id")), "candidates", ["cell", "near"])
    kinds = "query long, query_id long, copies long, vec_id long, score long, own long"
    parts = []
    for b in range(blocks if n and asked else 0):
        rows = asks.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        width = max(pivot.shape[1], *(len(r["v"]) for r in rows))
        q, p, s = (np.pad(m, ((0, 0), (0, max(0, width - m.shape[1])))) for m in (padded([r["v"] for r in rows], width), pivot, sample))
        wide = max(m.shape[1] for m in (q, p, s))
        q, p, s = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (q, p, s))
        query_ids, copies = np.array([r["vec_id"] for r in rows], np.int64), np.array([r["copies"] for r in rows], np.int64)
        least = np.sort(s @ q.T, axis=0)[-(k + 1)] - 1.0 if len(s) > k else np.full(len(q), -np.inf)
        shared = spark.sparkContext.broadcast((q, p, query_ids, copies, least))

        def run(batches, shared=shared, first=b << 32):
            q, p, query_ids, copies, least = shared.value
            best, scored = Best(len(q), k + 1, least.copy()), 0
            for batch in batches:
                x = matrix(batch.column("v"), q.shape[1])
                ids = batch.column("vec_id").to_numpy()
                far = x.shape[1] - q.shape[1]
                q2, p2 = (np.pad(m, ((0, 0), (0, far))) for m in (q, p))
                bounds = Pivots(p2)
                for at in range(0, len(x), BLOCK):
                    scored += search_block(bounds, x[at : at + BLOCK], ids[at : at + BLOCK], q2, query_ids, best)
            out = [np.r_[c, v] for c, v in zip((best.query + first, query_ids[best.query], copies[best.query], best.ids, best.score, best.own), (-1, -1, 0, -1, scored, 0), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in out], ["query", "query_id", "copies", "vec_id", "score", "own"])

        parts.append(save(placed.select("vec_id", "v").mapInArrow(run, kinds), f"best{b}"))
        shared.unpersist()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    if told is not None:
        told.update(pairs=n * asked, scored=found.where("query = -1").agg(F.sum("score")).first()[0])
    # At most k + 1 rows of each task and query meet here.
    order = [F.desc("score"), "vec_id"]
    others = found.where("query <> -1").withColumn("turn", F.row_number().over(Window.partitionBy("query", "own").orderBy(*order))).where("own = 0 or turn > 1")
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    each = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("query_id", "rank", "vec_id", "score")
