"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard checks, connected components."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import mix64, rolling, segments, signed, texts
from .workspace import save

SHINGLE = 5
BANDS, ROWS = 24, 4
ROUNDS = 2
NUMERATOR, DENOMINATOR = 80, 100


def permute(x: np.ndarray, salt: int) -> np.ndarray:
    """A permutation of the 32-bit universe (xor-shifts and odd multiplications), in place."""
    x ^= np.uint32(salt)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(t, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text, as sorted 64-bit hashes, and where each text's start (one more at the end).

    A text with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    words = t.hashes(lower=True)
    begin, inside = segments(t.first, t.count, k)
    hashes = rolling(words, k, 7)[begin] if len(begin) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(t.n), inside)
    short = np.flatnonzero((t.count > 0) & (t.count < k))
    if len(short):
        # Every length is salted on its own, so a short text never equals a longer one's shingle.
        whole = np.array([int(mix64(rolling(words[t.first[i] : t.first[i + 1]], int(t.count[i]), 1000 + int(t.count[i])))[0]) for i in short], np.uint64)
        hashes, doc = np.r_[hashes, whole], np.r_[doc, short]
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, bool)
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(t.n + 1))


def circulant_bands(sets: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The band keys of each nonempty set: coordinate k is the least pi(sigma(x) + k mod 2^32), so two permutations serve all."""
    placed = permute((sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32), 0x5BD1E995)
    keys = np.zeros((len(at), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(at), b + 1, np.uint64)
        for r in range(rows):
            value = permute(placed + np.uint32(b * rows + r), 0x27D4EB2F)
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value, at).astype(np.uint64))
        keys[:, b] = key
    return keys


def class_ids(sets: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """64 bits of a cryptographic digest of each set, which name the class of documents with that set."""
    return np.array([int.from_bytes(hashlib.blake2b(sets[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(cut[:-1], cut[1:], strict=True)], np.int64)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, kept, n_shingles, the id of the set's class, and its band keys (empty sets: none)."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, to, t in texts(batch.column("text"), 2 << 20):
                sets, cut = shingle_sets(t, shingle)
                size = np.diff(cut)
                full = np.flatnonzero(size)
                keys = circulant_bands(sets, cut[full], bands, rows) if len(full) else np.zeros((0, bands), np.uint64)
                upto = np.zeros(t.n + 1, np.int32)
                upto[1:] = np.cumsum(size > 0) * bands
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at), batch.column("kept").slice(at, to - at), pa.array(size.astype(np.int64)), pa.array(class_ids(sets, cut)), pa.ListArray.from_arrays(pa.array(upto), signed(keys.ravel()))],
                    ["doc_id", "kept", "n_shingles", "id", "bands"],
                )

    return docs.select("doc_id", "text", "kept").mapInArrow(run, f"doc_id long, kept {dict(docs.dtypes)['kept']}, n_shingles long, id long, bands array<long>")


def packed_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """The class id and the packed, sorted shingle hashes of each text."""

    def run(batches):
        for batch in batches:
            for _, _, t in texts(batch.column("text")):
                sets, cut = shingle_sets(t, shingle)
                yield pa.RecordBatch.from_arrays([pa.array(class_ids(sets, cut)), pa.array([sets[cut[i] : cut[i + 1]].tobytes() for i in range(t.n)], pa.binary())], ["id", "packed"])

    return docs.select("text").mapInArrow(run, "id long, packed binary")


def confirm(pairs: DataFrame, sets: DataFrame, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """Of pairs (id, hub), those whose full sets meet denominator * intersection >= numerator * union."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("mine"), batch.column("other")
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                if denominator * min(len(x), len(y)) >= numerator * max(len(x), len(y)):
                    where = np.searchsorted(y, x)
                    where[where == len(y)] = 0
                    both = int((y[where] == x).sum())
                    good[i] = denominator * both >= numerator * (len(x) + len(y) - both)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(keep), batch.column("hub").filter(keep)], ["id", "hub"])

    mine = pairs.join(sets.withColumnRenamed("packed", "mine"), "id")
    both = mine.join(sets.select(F.col("id").alias("hub"), F.col("packed").alias("other")), "hub")
    return both.select("id", "hub", "mine", "other").mapInArrow(run, "id long, hub long")


def prefix_pairs(rest: DataFrame, sets: DataFrame, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """Pairs (id, hub) of different components in rest (id, comp) that can reach the similarity; none that does is missing.

    Only shingles that two components hold can be in an intersection. Two sets that meet in at least t shingles of n share one of the
    first n - t + 1 of each in any common order; with the shingles of one component first, and then by the number of sets that hold
    them, these prefixes hold rare shingles only, or nothing. So near copies that differ each in its own way make no pairs with each
    other. Of two sets that share a prefix's shingle, one isn't of the component that holds it most often: pairs are made from that
    side, so a large component makes none with itself.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 64):
                packed = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("packed").slice(at, 64)]
                long = [len(x) for x in packed]
                repeated = [np.repeat(batch.column(c).slice(at, 64).to_numpy(), long) for c in ("id", "comp")]
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in (*repeated, np.repeat(np.array(long, np.int64), long))], pa.array(np.concatenate(packed))], ["id", "comp", "n", "shingle"])

    held = sets.join(rest.select("id", "comp").distinct(), "id").select("id", "comp", "packed")
    spread = save(held.mapInArrow(run, "id long, comp long, n long, shingle long"), "shingles")
    common = spread.groupBy("shingle").agg(F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("shingle", "df")
    own = Window.partitionBy("id")
    ranked = spread.join(common, "shingle").select("*", F.count("*").over(own).alias("c"), F.row_number().over(own.orderBy("df", "shingle")).alias("k"))
    least = F.ceil(F.col("n") * numerator / denominator)
    prefix = save(ranked.where(F.col("k") <= F.col("c") - least + 1).select("shingle", "id", "comp", "n", (F.col("c") - F.col("k") + 1).alias("left")), "prefixes")
    main = prefix.groupBy("shingle", "comp").count().groupBy("shingle").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("shingle", "main")
    left = prefix.join(main, "shingle").where("comp <> main").select("shingle", "id", "comp", "n", "left")
    right = prefix.join(main, "shingle", "left_semi").select("shingle", F.col("id").alias("hub"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("left").alias("left2"))
    # From their first common shingle on, two sets meet in no more than the lesser number that is left.
    able = (F.least("n", "n2") * denominator >= F.greatest("n", "n2") * numerator) & (F.least("left", "left2") * (numerator + denominator) >= (F.col("n") + F.col("n2")) * numerator)
    return left.join(right, "shingle").where((F.col("comp") != F.col("comp2")) & able).select(F.greatest("id", "hub").alias("id"), F.least("id", "hub").alias("hub")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, comp of every id in links (id, hub): comp is the smallest id reachable. Labels fall to the neighbours' least and then to
    the label's own label, which halves paths, until nothing changes."""
    both = save(links.select("id", "hub").union(links.select(F.col("hub").alias("id"), F.col("id").alias("hub"))).distinct(), "links")
    start = both.groupBy("id").agg(F.least(F.min("hub"), F.col("id")).alias("comp"))

    def fall(label: DataFrame) -> DataFrame:
        near = both.join(label.select(F.col("id").alias("hub"), "comp"), "hub").groupBy("id").agg(F.min("comp").alias("near"))
        step = label.join(near, "id").select("id", F.least("comp", "near").alias("next"), F.col("comp").alias("was"))
        jump = step.join(step.select(F.col("id").alias("next"), F.col("next").alias("far")), "next", "left")
        return jump.select("id", F.coalesce("far", "next").alias("comp"), "was")

    label = save(fall(start), "labels").select("id", "comp")
    for _ in range(most_rounds):
        new = save(fall(label), "labels")
        label = new.select("id", "comp")
        if new.where("comp <> was").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def near_components(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links of Jaccard >= 0.8 of the shingle sets), kept, and the columns of
    `keep` (names other than those).

    Equal sets are one class. In each round a bucket's classes are checked against one hub, and then against what is not yet in its
    component, so a group of copies costs its size and not its square; at the end, of the sets that share a bucket and are still apart,
    all pairs that can reach the similarity are checked (see prefix_pairs), so no link among the candidates is lost. A true link is
    missed by all bands with probability (1 - 0.8^rows)^bands. Rows with a null doc_id are left out; null and empty texts have no
    shingles and are alone; texts are whole at any length. Rows that share a doc_id are documents of their own: equal ones are copies,
    others are linked by their sets alone; each is returned, and kept where no smaller doc_id is in its component. Other columns are
    ignored. An empty table gives an empty result.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0).alias("none"), *(keep or [])).alias("kept"))
    signed_docs = save(signatures(docs, shingle, bands, rows), "signatures")
    full = signed_docs.where("n_shingles > 0")
    classes = save(full.groupBy("id").agg(F.min("doc_id").alias("first"), F.any_value("bands").alias("bands")), "classes")
    banded = classes.select("id", "first", F.explode("bands").alias("band"))
    met = banded.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("band")
    buckets = save(banded.join(met, "band").select("band", "id", "first"), "buckets")
    ids = buckets.select("id").distinct()
    firsts = classes.select("id", "first").join(ids, "id").select(F.col("first").alias("doc_id")).distinct()
    sets = save(packed_sets(docs.join(firsts, "doc_id", "left_semi"), shingle).join(ids, "id", "left_semi").dropDuplicates(["id"]), "sets")
    none = docs.sparkSession.createDataFrame([], "id long, hub long")
    found, tested, label = none, none, none.select("id", F.col("hub").alias("comp"))
    for r in range(rounds + 1):
        placed = buckets.join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id")) if r else buckets.withColumn("comp", F.col("id"))
        turn = F.xxhash64("id", F.lit(r)) if r else F.col("first")
        open_ = placed.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct(turn.alias("turn"), F.col("id"), F.col("comp"))).alias("h")).where("low < high")
        if r < rounds:
            hubs = open_.select("band", F.col("h.id").alias("hub"), F.col("h.comp").alias("hub_comp"))
            pairs = placed.join(hubs, "band").where("comp <> hub_comp").select(F.greatest("id", "hub").alias("id"), F.least("id", "hub").alias("hub")).distinct()
        else:
            pairs = prefix_pairs(placed.join(open_.select("band"), "band").select("id", "comp"), sets)
        pairs = save(pairs.join(tested, ["id", "hub"], "left_anti") if r else pairs, f"pairs{r}")
        if r and pairs.isEmpty():
            continue
        good = save(confirm(pairs, sets), f"good{r}")
        tested = tested.union(pairs)
        if r and good.isEmpty():
            continue
        found = found.union(good)
        label = components(found)
    label = classes.select("id", "first").join(label.select("id", "comp"), "id")
    least = label.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = classes.select("id", "first").join(label.join(least, "comp").select("id", "component_id"), "id", "left").select("id", F.coalesce("component_id", "first").alias("component_id"))
    facts = ["doc_id", "n_shingles", "kept"]
    placed = full.select("id", *facts).join(named, "id").select(*facts, "component_id")
    out = placed.union(signed_docs.where("n_shingles = 0").select(*facts, F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), *[F.col(f"kept.{c}").alias(c) for c in keep or []])
