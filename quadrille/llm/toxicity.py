"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by an extreme-value law."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import texts
from .workspace import save

#: Half of the table is for words, half for their first PREFIX bytes.
SLOTS = 1 << 20
PREFIX = 5
#: Bound of the labelled rows that are fitted on.
LABELLED = 30_000
DRIFT = 0.5
THRESHOLD = 0.3
PRIOR_FLAT, PRIOR_MASS = 0.5, 1000.0


def features(t) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each word: of the word in lower case, and of its first bytes."""
    half = np.uint64(SLOTS // 2)
    return (t.hashes(lower=True) % half).astype(np.int64), (t.hashes(lower=True, width=PREFIX) % half + half).astype(np.int64)


def _count(batches):
    counts = {0: np.zeros(SLOTS, np.int64), 1: np.zeros(SLOTS, np.int64)}
    for batch in batches:
        toxic = np.asarray(batch.column("toxic"))
        for at, to, t in texts(batch.column("text")):
            label = np.repeat(toxic[at:to], t.count)
            for slot in features(t):
                for k in (0, 1):
                    counts[k] += np.bincount(slot[label == k], minlength=SLOTS)
    used = np.flatnonzero(counts[0] + counts[1])
    for i in range(0, len(used), 100_000):
        part = used[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[1][part]), pa.array(counts[0][part])], ["slot", "toxic", "clean"])


def training_labels(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """At most `most` labelled ids to fit on (crc32 of the id modulo 4 is not 2), by a hash of the id. A repeated id is toxic if one of its rows is."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    once = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2


def log_odds(docs: DataFrame, train: DataFrame) -> np.ndarray:
    """A score for each slot: the bound of its log-odds (toxic to clean) that is nearer 0, under Dirichlet priors of the overall rates."""
    labelled = docs.join(F.broadcast(train), "doc_id").select("text", "toxic")
    counts = labelled.mapInArrow(_count, "slot long, toxic long, clean long").groupBy("slot").agg(F.sum("toxic").alias("c1"), F.sum("clean").alias("c0"))
    counts = save(counts, "token-counts")
    n1, n0 = counts.agg(F.sum("c1"), F.sum("c0")).first()
    table = np.zeros(SLOTS, np.float32)
    if not n1 or not n0:
        return table
    rate = (F.col("c1") + F.col("c0")) / float(n1 + n0)
    prior = rate * PRIOR_MASS + PRIOR_FLAT
    a, b = F.col("c1") + prior, F.col("c0") + prior
    delta = F.ln(a / (n1 + PRIOR_MASS)) - F.ln(b / (n0 + PRIOR_MASS))
    sure = F.greatest(F.abs(delta) - 2 * F.sqrt(1 / a + 1 / b), F.lit(0.0))
    kept = counts.select("slot", (F.signum(delta) * sure).alias("s")).where(F.abs("s") > 0.1).toPandas()  # SLOTS rows at most
    table[kept["slot"].to_numpy()] = kept["s"].to_numpy()
    return table


def scan(score: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Every maximal-scoring segment of each group (Ruzzo and Tompa): rows (first, last, sum), by first; of equal peaks the earlier.

    Runs of positive tokens enter a stack from the left. A segment knows the nearest one before it that starts lower, so a new run skips
    what can't be its beginning; what has been skipped is never looked at again, and each join takes segments off. Linear in the tokens.
    """
    positive = score > 0
    new = np.r_[True, group[1:] != group[:-1]] if len(score) else np.zeros(0, bool)
    begins = positive & (new | ~np.r_[False, positive[:-1]])
    ends = positive & (np.r_[new[1:], True] | ~np.r_[positive[1:], False])
    upto = np.r_[0.0, np.cumsum(score)]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    before, after, home = upto[first].tolist(), upto[last + 1].tolist(), group[first].tolist()
    start, stop, low, high, lower = [], [], [], [], []
    base, now = 0, None
    for i, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        if home[i] != now:
            base, now = len(start), home[i]
        x, y = before[i], after[i]
        j = len(start) - 1
        while True:
            while j >= base and low[j] >= x:
                j = lower[j]
            if j < base or high[j] >= y:
                break
            # The segment reaches a new peak through this run: they are one, and what lies between goes.
            a, x, j_before = start[j], low[j], lower[j]
            del start[j:], stop[j:], low[j:], high[j:], lower[j:]
            j = j_before
        start.append(a), stop.append(b), low.append(x), high.append(y), lower.append(j)
    return np.stack([np.array(start, float), np.array(stop, float), np.array(high) - np.array(low)], 1) if start else np.zeros((0, 3))


def passages(docs: DataFrame, table: np.ndarray, drift: float = DRIFT, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_words and every positive segment of each whole text: its first word, its length and its score; and `keep` as a struct."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for at, to, t in texts(batch.column("text")):
                word, head = features(t)
                a, b = table[word], table[head]
                score = np.where(np.abs(a) > np.abs(b), a, b).astype(np.float64) - drift
                doc = t.doc
                found = scan(score, doc)
                d = doc[found[:, 0].astype(int)] if len(found) else np.zeros(0, int)
                order = np.lexsort((found[:, 0], d))
                found, d = found[order], d[order]
                cuts = np.searchsorted(d, np.arange(to - at + 1)).astype(np.int32)
                first = found[:, 0].astype(np.int64) - t.first[d]
                long = (found[:, 1] - found[:, 0]).astype(np.int64) + 1
                seg = pa.StructArray.from_arrays([pa.array(first), pa.array(long), pa.array(found[:, 2])], ["first", "length", "score"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at:to]), pa.array(t.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), seg), batch.column("kept").slice(at, to - at)], ["doc_id", "n_words", "passages", "kept"])

    kept = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *(keep or [])).alias("kept"))
    return kept.mapInArrow(run, f"doc_id long, n_words long, passages array<struct<first: long, length: long, score: double>>, kept {dict(kept.dtypes)['kept']}")


@dataclass
class Calibration:
    """Of best segments of clean texts: the Gumbel law (rate lam, constant k per word); of documents: a logistic line on log evidence."""

    lam: float = 1.0
    k: float = 1e-3
    bias: float = -20.0
    slope: float = 1.0

    def evidence(self) -> Column:
        """Sum of -ln P over the passages that are expected less than once in a clean text of this length."""
        expected = lambda p: F.lit(self.k) * F.greatest("n_words", F.lit(1)) * F.exp(-F.lit(self.lam) * p["score"])
        surprise = lambda e: -F.ln(F.greatest(-F.expm1(-e), F.lit(1e-300)))
        return F.aggregate("passages", F.lit(0.0), lambda s, p: s + F.when(expected(p) < 1, surprise(expected(p))).otherwise(0.0))

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.bias) + F.lit(self.slope) * F.log1p(self.evidence()))))


def calibrate(found: DataFrame, train: DataFrame) -> Calibration:
    """Fits both laws on the bounded labelled rows."""
    best = F.coalesce(F.array_max(F.transform("passages", lambda p: p["score"])), F.lit(0.0))
    rows = found.join(F.broadcast(train), "doc_id")
    clean = rows.where("toxic = 0").select("n_words", best.alias("best")).where("n_words > 0").toPandas().sort_values(["n_words", "best"])
    out = Calibration()
    if len(clean) > 1 and clean["best"].std(ddof=0) > 1e-6:
        out.lam = math.pi / (clean["best"].std(ddof=0) * math.sqrt(6))
        out.k = math.exp(min(50.0, out.lam * clean["best"].mean() - 0.5772156649 - np.log(clean["n_words"]).mean()))
    fit = rows.select(F.log1p(out.evidence()).alias("x"), "toxic").toPandas().sort_values(["x", "toxic"])
    x, y = fit["x"].to_numpy(float), fit["toxic"].to_numpy(float)
    if y.size and 0 < y.sum() < y.size:
        w = np.array([math.log(y.mean() / (1 - y.mean())), 0.0])
        design = np.stack([np.ones_like(x), x], 1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            grad = design.T @ (y - p) - 1e-3 * w
            hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        out.bias, out.slope = float(w[0]), float(max(w[1], 0.0))
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, keep: list[str] | None = None) -> DataFrame:
    """Scores every whole text: doc_id, held_out, score (0 to 1), predicted (score >= 0.3), n_words, passages (significant or not) and the
    columns of `keep` (names other than those).

    Only the text of a document enters its score. Null and empty texts get the score of no evidence; texts are whole at any length. Rows
    with a null doc_id are left out; rows that share a doc_id, equal or not, are scored each, and a label of the id counts for all of
    them. Without labels of both kinds all scores are near 0. Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *(keep or []))
    train = save(training_labels(labels, labelled), "training-labels")
    found = save(passages(docs, log_odds(docs, train), keep=keep), "passages")
    law = calibrate(found, train)
    scored = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), law.probability().alias("score"), "n_words", "passages", "kept")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_words", "passages", *[F.col(f"kept.{c}").alias(c) for c in keep or []])
