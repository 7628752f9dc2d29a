"""SimHash fingerprints and permuted block tables, in DataFrame operations only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 64
LANES = 0x0000000100000001
SPLIT = r"[\x20\x09-\x0D]+"
#: Buckets of the order on doc_id: cells between percentiles, cut evenly; at most COARSE * FINE of them.
COARSE, FINE, ROWS = 64, 1024, 256


def terms(text: Column) -> Column:
    """The terms of a text: its words in lower case."""
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def votes(term: str) -> list[Column]:
    """Weighted votes of a term column: the weight of a term is the length of its word, at most 12 (common words are short).

    Column k holds bits k and k+32 in the halves of a long, so 32 sums carry the votes on 64 bits.
    """
    h, w = F.xxhash64(term), F.least(F.coalesce(F.char_length(term), F.lit(0)), F.lit(12)).cast("long")
    return [F.sum(w * F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES))).alias(f"v{k}") for k in range(32)] + [F.sum(w).alias("total")]


def signs() -> Column:
    """The fingerprint of summed votes: bit i is set if more than half of the weight votes for it."""
    out = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"v{k}"), 32)
        for bit, v in ((k, low), (k + 32, high)):
            weight = (1 << bit) - (1 << 64 if bit == 63 else 0)
            out = out.bitwiseOR(F.when(v * 2 > F.col("total"), F.lit(weight).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def as_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def ordered_buckets(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with a bucket that rises with doc_id, and [(bucket, first doc_id)] of the buckets in use, at most COARSE * FINE of them."""
    n, low, high, cuts = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / COARSE for i in range(1, COARSE)], 10000)).first()
    if not n:
        return docs.withColumn("bucket", F.lit(0)), []
    edges = [low, *sorted({c for c in cuts if c > low}), high + 1]
    fine = max(1, min(FINE, -(-n // (ROWS * (len(edges) - 1)))))
    starts = F.array(*[F.lit(e).cast("long") for e in edges[:-1]])
    ends = F.array(*[F.lit(e).cast("long") for e in edges[1:]])
    cell = F.size(F.filter(starts, lambda e: e <= F.col("doc_id")))
    part = docs.withColumn("cell", cell)
    a, b = F.element_at(starts, F.col("cell")), F.element_at(ends, F.col("cell"))
    within = F.floor((F.col("doc_id") - a).cast("double") * fine / (b - a).cast("double"))
    out = part.withColumn("bucket", ((F.col("cell") - 1) * fine + F.least(within, F.lit(fine - 1))).cast("int")).drop("cell")
    return out, [tuple(r) for r in out.groupBy("bucket").agg(F.min("doc_id")).orderBy("bucket").collect()]


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what the next document holds: text (after the last: the first), by (doc_id, text). Each bucket also gets the
    first document of the next bucket, as a row with halo = true, so no task orders more than a bucket."""
    docs, used = ordered_buckets(docs)
    spark = docs.sparkSession
    halo = [(used[i][1], used[i - 1][0], i == 0) for i in range(len(used))]
    ends = spark.createDataFrame(halo, "doc_id long, into int, wraps boolean")
    extra = docs.join(ends, "doc_id").select("doc_id", "text", F.col("into").alias("bucket"), F.lit(True).alias("halo"))
    return docs.select("doc_id", "text", "bucket", F.lit(False).alias("halo")).unionByName(extra)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints each whole text and its edited text: the last quarter of its code points replaced by the first of the next document's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (16 hex digits), near_edited and near_next (share of equal
    bits). Null and empty texts have the fingerprint 0. Rows with a null doc_id are left out; rows that share a doc_id are documents
    of their own, in the order of their texts. Ties in a vote give 0. An empty table gives an empty result.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("bucket").orderBy("halo", "doc_id", "text")
    placed = with_next(docs).select("*", F.row_number().over(order).alias("pos"), F.lead("text").over(order).alias("next"))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    # The digest is made here, once a text, and not after the terms are rows; as a grouping key, since hash aggregation sums no strings.
    sha = F.sha2(F.encode(edited, "UTF-8"), 256)
    two = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("s"), F.lit(None).cast("string").alias("sha")), F.struct(F.lit(1).alias("which"), edited.alias("s"), sha.alias("sha")))
    both = placed.select("bucket", "pos", "halo", "doc_id", n.cast("long").alias("n_chars"), F.explode(two).alias("x"))
    both = both.where(~F.col("halo") | (F.col("x.which") == 0))
    keys = ["bucket", "pos", "halo", "doc_id", "n_chars", "which", "sha"]
    voted = both.select(*keys[:5], "x.which", "x.sha", F.explode_outer(terms(F.col("x.s"))).alias("term"))
    voted = voted.groupBy(*keys).agg(*votes("term")).na.fill(0, [*(f"v{k}" for k in range(32)), "total"])
    prints = voted.select(*keys, signs().alias("fp"))
    each = Window.partitionBy("bucket").orderBy("pos", "which")
    # Rows of a bucket: (text, edited) of each document in order; the next document's text is two rows on from a text.
    flat = prints.select("*", F.lead("fp", 1).over(each).alias("edited_fp"), F.lead("sha", 1).over(each).alias("edited_sha256"), F.lead("fp", 2).over(each).alias("next_fp"))
    out = flat.where((F.col("which") == 0) & ~F.col("halo"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def near_pairs(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs of distinct fingerprints (a < b, with their distance) within the Hamming radius, by permuted block tables.

    The 64 bits are cut into `blocks`; two fingerprints within the radius agree on at least blocks - radius of them, so one table for
    each choice of that many blocks, keyed by those bits, misses none. prints: fingerprint (16 hex digits); equal ones count once,
    null ones not at all. Callers map documents to fingerprints themselves: copies make no pairs.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be at least 0 and below blocks")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    fp = F.conv("fingerprint", 16, -10).cast("long")
    once = prints.where(F.col("fingerprint").isNotNull()).select("fingerprint").distinct().select("fingerprint", fp.alias("fp"))
    table = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(masks)])
    keyed = once.select("fp", "fingerprint", F.explode(table).alias("x")).select("fp", "fingerprint", "x.t", "x.k")
    a = keyed.select("t", "k", F.col("fp").alias("fa"), F.col("fingerprint").alias("a"))
    b = keyed.select("t", "k", F.col("fp").alias("fb"), F.col("fingerprint").alias("b"))
    distance = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))
    near = a.join(b, ["t", "k"]).where((F.col("a") < F.col("b")) & (distance <= radius))
    return near.select("a", "b", distance.alias("distance")).distinct()
