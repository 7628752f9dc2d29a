"""Entropy balancing of sources to token targets, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import checkpoint, save

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 2
SHARE = 1.5
SALTS = 64
LAMBDA_BOUND = 4096.0


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row per source (skey): source_size, docs, target. Targets fill up by weight to at most `most` times the source."""
    total = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sizes.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"), F.first("source").alias("source"))
    # One row a source from here on: a single task orders source names, not documents.
    ranked = sources.withColumn("i", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", "i").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(total) * F.lit(share)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(total) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    filled = ranked.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "i", "level"))).over(total)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("level"), F.col("cap")))
    return filled.select("skey", "source_size", "docs", target.alias("target"))


def tilted_rates(cells: DataFrame, targets: DataFrame, most: int = MOST_COPIES, tolerance: float = 1e-7, rounds: int = 40) -> DataFrame:
    """The convex dual, solved for all sources at once by safeguarded Newton steps: one aggregation over (source, size) cells each.

    Minimises sum n (r ln r - r + 1) over 0 <= r <= most with sum n size r = target, so r = min(most, exp(lambda size / mean)).
    Sums are decimal, so that reruns agree to the last bit. Returns cells with rate, target and source_size.
    """
    mean = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))
    state = checkpoint(targets.select("*", mean.alias("mean"), F.lit(0.0).alias("lam"), F.lit(-LAMBDA_BOUND).alias("lo"), F.lit(LAMBDA_BOUND).alias("hi")))
    top = math.log(most)
    x = F.col("size") / F.col("mean")
    z = F.greatest(F.least(F.col("lam") * x, F.lit(top)), F.lit(-700.0))
    exact = lambda c: F.sum(c.cast("decimal(30,6)")).cast("double")
    for _ in range(rounds):
        mass = F.col("n") * F.col("size") * F.exp(z)
        step = cells.join(state, "skey").groupBy("skey").agg(
            exact(mass).alias("f"), exact(F.when(F.col("lam") * x < top, mass * x).otherwise(0.0)).alias("slope"),
            *[F.first(c).alias(c) for c in ("source_size", "docs", "target", "mean", "lam", "lo", "hi")],
        ).withColumn("err", F.col("f") - F.col("target"))
        step = step.withColumn("lo", F.when(F.col("err") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("err") > 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.col("err") / F.when(F.col("slope") > 1e-9, F.col("slope"))
        lam = F.when(F.abs("err") <= 1e-6, F.col("lam")).when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = checkpoint(step.select("skey", "source_size", "docs", "target", "mean", lam.alias("lam"), "lo", "hi", "err"))
        worst = state.agg(F.max(F.when(F.col("target") < F.col("source_size") * most * (1 - 1e-9), F.abs("err") / F.greatest("source_size", F.lit(1))))).first()[0]
        if worst is None or worst <= tolerance:
            break
        state = state.drop("err")
    else:
        raise RuntimeError(f"entropy balancing did not converge in {rounds} rounds")
    full = F.col("target") >= F.col("source_size") * most * (1 - 1e-9)
    rate = F.when(full, F.lit(float(most))).otherwise(F.exp(z))
    return cells.join(state, "skey").select("skey", "size", "n", rate.alias("rate"), "target", "source_size")


def whole_copies(rated: DataFrame, most: int = MOST_COPIES, corrections: int = 5) -> DataFrame:
    """Copies m of each (source, size) cell: rounds the running sum of n * rate, largest size first, then moves a copy or so to meet the target."""
    source = Window.partitionBy("skey")
    run = Window.partitionBy("skey").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    out = rated.withColumn("c", F.floor(F.sum(F.col("n") * F.col("rate")).over(run) + 0.5))
    out = out.withColumn("m", F.greatest(F.lit(0), F.least(F.col("c") - F.coalesce(F.lag("c").over(Window.partitionBy("skey").orderBy(F.desc("size"))), F.lit(0)), F.col("n") * most)))
    for _ in range(corrections):
        out = out.withColumn("e", F.col("target") - F.sum(F.col("size") * F.col("m")).over(source))
        able = (F.col("size") > 0) & F.when(F.col("e") > 0, F.col("m") < F.col("n") * most).otherwise(F.col("m") > 0)
        best = F.min(F.when(able, F.struct(F.abs(F.abs("e") - F.col("size")).alias("d"), F.col("size").alias("s")))).over(source)
        out = out.withColumn("best", best)
        out = out.withColumn("m", F.col("m") + F.when((F.col("best.d") < F.abs("e")) & (F.col("best.s") == F.col("size")), F.signum("e").cast("long")).otherwise(0))
    return out.select("skey", "size", "n", "m", "target", "source_size")


def mix(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Mixes documents to their sources' token targets by entropy balancing.

    Returns doc_id, size, source_size, target, copies (0 to 2), taken, one row per input row; keep: other columns of docs to return.
    Null or empty texts have size 0 and are taken 0 words of; null is a source of its own, the last. Rows with a null doc_id take no
    part. Rows that share a doc_id, equal or not, are documents of their own. Texts are whole at any length. An empty table gives an
    empty result. Other columns of docs are ignored.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    base = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), F.col("source"), size.alias("size"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(SALTS)).cast("int").alias("salt"), F.struct(F.lit(0).alias("none"), *(keep or [])).alias("kept"),
    )
    base = save(base, "sizes")
    parts = save(base.groupBy("skey", "size", "salt").agg(F.count("*").alias("k"), F.first("source").alias("source")), "cells")
    cells = checkpoint(parts.groupBy("skey", "size").agg(F.sum("k").alias("n"), F.first("source").alias("source")))
    rated = tilted_rates(cells.drop("source"), checkpoint(source_targets(cells)))
    counted = whole_copies(rated)
    # A cell's copies are dealt to its salts in proportion, so no task ever ranks a whole cell.
    run = Window.partitionBy("skey", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    dealt = parts.drop("source").join(counted, ["skey", "size"]).withColumn("upto", F.sum("k").over(run))
    share = lambda c: F.floor(F.col("m").cast("decimal(38,0)") * c.cast("decimal(20,0)") / F.col("n"))
    dealt = dealt.select("skey", "size", "salt", "k", "target", "source_size", (share(F.col("upto")) - share(F.col("upto") - F.col("k"))).cast("long").alias("m"))
    order = Window.partitionBy("skey", "size", "salt").orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id")
    ranked = base.drop("source").join(dealt, ["skey", "size", "salt"]).withColumn("place", F.row_number().over(order))
    each = F.floor(F.col("m") / F.col("k"))
    copies = (each + F.when(F.col("place") <= F.col("m") - each * F.col("k"), 1).otherwise(0)).cast("long")
    out = ranked.select("doc_id", "size", "source_size", "target", copies.alias("copies"), *[F.col(f"kept.{c}").alias(c) for c in keep or []])
    return out.withColumn("taken", F.col("copies") * F.col("size"))
