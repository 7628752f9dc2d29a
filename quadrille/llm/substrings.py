"""Repeated word windows: shards of candidate passages, each with an FM-index over a wavelet tree that streamed passages search backward."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix64, rolling, segments, texts
from .workspace import save

WINDOW = 50
#: Length of the anchors by which passages are dealt to groups: every window has one, the least of its anchor hashes.
ANCHOR = 20
#: Distinct passages of a shard, about, and of a group before it is split by the words next to its anchor.
SHARD, GROUP = 4000, 1000
NEVER = np.iinfo(np.int64).max


class WaveletTree:
    """Rank of any symbol in a sequence: one bit vector for each bit of the symbols, highest first, with counts every 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.words, self.counts, self.zeros = [], [], []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.zeros.append(self.n - int(bit.sum()))
            now = np.r_[now[bit == 0], now[bit == 1]]

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol is found before each position."""
        low, high = np.zeros_like(position), position
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self._ones(k, low), self._ones(k, high)
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def _ones(self, k: int, position: np.ndarray) -> np.ndarray:
        at = position >> 6
        mask = (np.uint64(1) << (position & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[k][at] + np.bitwise_count(self.words[k][at] & mask).astype(np.int64)


class FMIndex:
    """Passages (arrays of word numbers from 0) under a suffix order by their first `depth` words.

    A range of suffixes that begin with at most depth - 1 given words can be extended by a word to the left, by rank in the transform.
    Holds the classes that share depth - 1 words, and the least owner of each class that shares `depth`.
    """

    def __init__(self, passages: np.ndarray, at: np.ndarray, owner: np.ndarray, depth: int):
        long = np.diff(at)
        # Each passage ends with the symbol 0; words are numbered from 1.
        text = np.insert(passages + 1, at[1:], 0)
        doc = np.insert(np.repeat(owner, long), at[1:], np.iinfo(np.int64).max)
        room = np.repeat(at[1:] + np.arange(len(long)), long + 1) - np.arange(len(text))
        rank, span = text.astype(np.int64), 1
        while span < depth:
            step = min(span, depth - 1 - span) or 1
            after = np.zeros(len(text), np.int64)
            after[: len(text) - step] = rank[step:] + 1
            after[room < step] = 0
            shorter, key = rank, rank * (int(rank.max()) + 3) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(len(text), np.int64)
            rank[order] = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
            span += step
        self.n, self.depth = len(text), depth
        self.first = np.searchsorted(np.sort(text), np.arange(int(text.max()) + 2))
        self.transform = WaveletTree(text[order - 1], max(1, int(text.max()).bit_length()))
        starts = np.flatnonzero(np.diff(shorter[order], prepend=-1))
        self.low = starts[np.cumsum(np.diff(shorter[order], prepend=-1) != 0) - 1]
        self.high = np.r_[starts[1:], self.n][np.cumsum(np.diff(shorter[order], prepend=-1) != 0) - 1]
        exact = np.diff(rank[order], prepend=-1) != 0
        self.least = np.minimum.reduceat(doc[order], np.flatnonzero(exact))[np.cumsum(exact) - 1]

    def extend(self, low: np.ndarray, high: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin with a word and go on with the suffixes of [low, high)."""
        start = self.first[word]
        return start + self.transform.rank(word, low), start + self.transform.rank(word, high)


def window_owners(flat: np.ndarray, at: np.ndarray, index: FMIndex) -> np.ndarray:
    """Matching statistics cut at the index's depth: for each position of streamed passages, the least owner of the window of `depth`
    words that starts there, or the greatest long where the longest match is shorter. flat: word numbers, or -1 for unknown words.

    All passages step back together. A match of depth - 1 words is extended by the word to its left; the found range is then widened
    to the class of its first depth - 1 words. Where no extension is found, the match loses its last word and is found anew.
    """
    depth, out = index.depth, np.full(len(flat), np.iinfo(np.int64).max, np.int64)
    live = np.flatnonzero(np.diff(at) >= depth)
    low, high = np.zeros(len(live), np.int64), np.full(len(live), index.n, np.int64)
    matched, here = np.zeros(len(live), np.int64), at[live + 1] - 1
    while len(live):
        word = flat[here] + 1
        a, b = index.extend(low, high, np.maximum(word, 0))
        ok = (b > a) & (word > 0)
        whole = ok & (matched == depth - 1)
        out[here[whole]] = index.least[a[whole]]
        grown = np.where(ok, np.minimum(matched + 1, depth - 1), 0)
        low, high = np.where(ok, a, 0), np.where(ok, b, index.n)
        wide = np.flatnonzero(whole)
        low[wide], high[wide] = index.low[a[wide]], index.high[a[wide]]
        here = np.where(ok, here - 1, here + matched - 1)
        matched = grown
        stay = here >= at[live]
        live, here, low, high, matched = live[stay], here[stay], low[stay], high[stay], matched[stay]
    return out


def word_facts(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, n_words, sha (of the words joined by a space), u (its first 64 bits) and the anchors of each whole text: keys and positions.

    An anchor is a run of `anchor` words whose hash is the least among those of some window, so equal windows have equal anchors.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, to, t in texts(batch.column("text")):
                joined = [hashlib.sha256(b" ".join(t.bytes_of(i).split())) for i in range(t.n)]
                where, key = anchors(t, window, anchor)
                doc = np.searchsorted(t.first, where, "right") - 1
                cuts = pa.array(np.searchsorted(where, t.first).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at), pa.array(t.count.astype(np.int64)), pa.array([x.hexdigest() for x in joined]), pa.array([first_bits(x.digest()) for x in joined], pa.int64()),
                     pa.ListArray.from_arrays(cuts, pa.array(key.view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array((where - t.first[doc]).astype(np.int32)))],
                    ["doc_id", "n_words", "sha", "u", "keys", "places"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, sha string, u long, keys array<long>, places array<int>")


def first_bits(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every `width` consecutive entries, by doubling."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x = best(x[: len(x) - step], x[step:])
        span += step
    return x


def anchors(t, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of the anchors (as indices of all words), ascending, and their hashes."""
    width = window - anchor + 1
    begin, _ = segments(t.first, t.count, window)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = rolling(t.hashes(), anchor, 11) | np.uint64(1)
    least = sliding(hashes, width, np.minimum)
    lows = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    lows[width - 1 + begin] = least[begin]
    where = np.flatnonzero(sliding(lows, width, np.maximum) == hashes)
    return where, hashes[where]


def named(body: bytes) -> tuple[int, int]:
    """128 bits that name some words."""
    digest = hashlib.blake2b(body, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def rows_of(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()).cast(k) if k == pa.string() else pa.array(list(c), k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


PASSAGE = [("doc_id", pa.int64()), ("u", pa.int64()), ("key", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("start", pa.int64()), ("spot", pa.int64()), ("words", pa.string())]


def passages(candidates: DataFrame, window: int, anchor: int) -> DataFrame:
    """What surrounds each anchor, just wide enough for every window over it: doc_id, u, key, the passage's name (p1, p2), its first
    word's place in the text (start), the anchor's place in it (spot) and its words."""

    def run(batches):
        reach = window - anchor
        for batch in batches:
            for doc, u, text, spots in zip(*(batch.column(c) for c in ("doc_id", "u", "text", "spots")), strict=True):
                words, rows = text.as_py().encode("utf-8", "replace").split(), []
                for spot in spots.as_py():
                    a = max(0, spot["place"] - reach)
                    body, at = b" ".join(words[a : spot["place"] + anchor + reach]), spot["place"] - a
                    rows.append((doc.as_py(), u.as_py(), spot["key"], *named(b"%d " % at + body), a, at, body))
                yield rows_of(rows, PASSAGE)

    return candidates.mapInArrow(run, "doc_id long, u long, key long, p1 long, p2 long, start long, spot long, words string")


def distinct(passages: DataFrame) -> DataFrame:
    """Each passage of a group (key) once, with the least and the greatest doc_id that hold it. low, high: where its windows may start,
    counted from the anchor."""
    facts = [F.min("least").alias("least"), F.max("most").alias("most"), *[F.any_value(c).alias(c) for c in ("spot", "low", "high", "words")]]
    return passages.groupBy("key", "p1", "p2").agg(*facts)


def halves(groups: DataFrame, window: int) -> DataFrame:
    """Splits passages: the windows that start in the first half of [low, high] and those of the second are passages of their own. All
    windows of a half hold the same words around the anchor, which go into the new key, so equal windows stay together and passages
    that differ in those words part. With low = high, a group is one window's copies. off: the new passage's place in the old one."""
    kinds = [(c, pa.int64()) for c in ("key", "p1", "p2", "key2", "q1", "q2", "off", "least", "most", "spot", "low", "high")] + [("words", pa.string())]

    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                words, mid = x["words"].encode("utf-8", "replace").split(b" "), (x["low"] + x["high"]) // 2
                for low, high in ((x["low"], mid), (mid + 1, x["high"])):
                    a, b = max(0, x["spot"] + low), min(len(words), x["spot"] + high + window)
                    if low <= high and b - a >= window and x["spot"] + high >= a and x["spot"] + low + window <= b:
                        body, spot = b" ".join(words[a:b]), x["spot"] - a
                        fixed = b" ".join(words[x["spot"] + high : x["spot"] + low + window])
                        key = named(b"%d %d %d " % (x["key"], low, high) + fixed)[0]
                        rows.append((x["key"], x["p1"], x["p2"], key, *named(b"%d " % spot + body), a, x["least"], x["most"], spot, low, high, body))
            yield rows_of(rows, kinds)

    return groups.mapInArrow(run, ", ".join(f"{c} {'string' if k == pa.string() else 'long'}" for c, k in kinds))


def search_shard(table: pa.Table, window: int) -> pa.Table:
    """Builds the FM-index of a shard's distinct passages and streams them through it. Of each passage: the runs of windows (first a, last
    b) with one least owner, where that is smaller than the greatest doc_id that holds the passage."""
    coded = table["words"].combine_chunks().dictionary_encode()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    code = coded.indices.to_numpy(zero_copy_only=False)
    owner = np.full(len(coded.dictionary), NEVER, np.int64)
    np.minimum.at(owner, code, table["least"].to_numpy())
    hashes, count = [], []
    for _, _, t in texts(coded.dictionary):
        hashes.append(t.hashes())
        count.append(t.count)
    _, flat = np.unique(np.concatenate(hashes), return_inverse=True)
    count = np.concatenate(count)
    at = np.r_[0, np.cumsum(count)]
    least = window_owners(flat, at, FMIndex(flat, at, owner, window))
    long = count[code]
    row = np.repeat(np.arange(len(code)), long)
    place = np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long)
    own = least[at[code][row] + place]
    hit = np.flatnonzero(own < table["most"].to_numpy()[row])
    row, place, own = row[hit], place[hit], own[hit]
    head = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(place) != 1) | (np.diff(own) != 0)][: len(row)])
    last = np.r_[head[1:], len(row)][: len(head)] - 1
    runs = pa.StructArray.from_arrays([pa.array(place[head].astype(np.int64)), pa.array(place[last].astype(np.int64)), pa.array(own[head])], ["a", "b", "owner"])
    some, first = np.unique(row[head], return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(head)].astype(np.int32)), runs)
    keys = [table[c].combine_chunks().take(pa.array(some)) for c in ("key", "p1", "p2")]
    return pa.table([*keys, lists], names=["key", "p1", "p2", "runs"])


def owned_runs(found: DataFrame, window: int, shard: int, group: int) -> DataFrame:
    """key, p1, p2, runs of the distinct passages in found (key, p1, p2, least, most, spot, low, high, words), through FM-indexes.

    A group of more than `group` distinct passages is halved, and so are its halves, until none is larger; since a group of one window
    has one passage, log2 of the window's length bounds the rounds. Shards take whole groups, and so hold a bounded number of passages.
    """
    ready, maps = [], []
    while True:
        many = found.groupBy("key").count().where(F.col("count") > group).select("key")
        many = save(many, "large-groups")
        if many.isEmpty():
            ready.append(found)
            break
        ready.append(found.join(many, "key", "left_anti"))
        split = save(halves(found.join(many, "key"), window), "halves")
        maps.append(split.select("key", "p1", "p2", "key2", "q1", "q2", "off").distinct())
        renamed = split.select(F.col("key2").alias("key"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), "least", "most", "spot", "low", "high", "words")
        found = distinct(renamed)
        alone = found.groupBy("key").agg(F.min("least").alias("l"), F.max("most").alias("m")).where("l < m").select("key")
        found = save(found.join(alone, "key", "left_semi"), "passages-split")
    every = ready[0]
    for x in ready[1:]:
        every = every.unionByName(x)
    shards = max(1, -(-every.count() // shard))
    placed = every.select("key", "p1", "p2", "least", "most", "words").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    out = placed.groupBy("shard").applyInArrow(lambda t: search_shard(t, window), "key long, p1 long, p2 long, runs array<struct<a: long, b: long, owner: long>>")
    if maps:
        out = save(out, "runs")
    for x in reversed(maps):
        found = x.join(out.select(F.col("key").alias("key2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "runs"), ["key2", "q1", "q2"])
        moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("off")).alias("a"), (r["b"] + F.col("off")).alias("b"), r["owner"].alias("owner")))
        both = found.select("key", "p1", "p2", moved.alias("runs")).groupBy("key", "p1", "p2").agg(F.flatten(F.collect_list("runs")).alias("runs"))
        out = out.unionByName(both)
    return out


def cut_texts(candidates: DataFrame) -> DataFrame:
    """doc_id, u, n_removed, kept of candidates with their ranges (array of a, b)."""

    def run(batches):
        for batch in batches:
            removed, kept = [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                words = text.as_py().encode("utf-8", "replace").split()
                stay = np.ones(len(words), bool)
                for s in spans:
                    stay[s["a"] : s["b"]] = False
                removed.append(int(len(words) - stay.sum()))
                kept.append(b" ".join(w for w, k in zip(words, stay.tolist(), strict=True) if k))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("u"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "u", "n_removed", "kept"])

    return candidates.mapInArrow(run, "doc_id long, u long, n_removed long, kept string")


def dedup_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, group: int = GROUP, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Removes each word covered by a window of `window` words that also starts in a document with a smaller doc_id.

    Returns (doc_id, n_words, n_removed, kept_sha256) of every document, and (doc_id, kept) of those that lose some but not all words.
    Whole texts with an equal word sequence are settled at once. Of the rest, passages around anchors that several documents share are
    reduced to distinct ones with their least doc_id; each is searched backward once, in its shard's FM-index, and the runs found are
    joined back to the documents that hold it. Null and empty texts have no words; texts are whole at any length. Rows with a null
    doc_id are left out; rows that share a doc_id (equal or not) are returned each and never remove each other's words. Columns other
    than doc_id and text are ignored. An empty table gives an empty result.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    facts = save(word_facts(docs, window, anchor), "facts")
    slim = facts.select("doc_id", "u", "sha", "n_words").where(F.col("n_words") >= window)
    firsts = slim.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = save(slim.join(firsts.select("sha", "first"), "sha").where("first < doc_id").select("doc_id", "u").distinct(), "copies")
    spots = facts.join(copies, ["doc_id", "u"], "left_anti").select("doc_id", "u", F.explode(F.arrays_zip("keys", "places")).alias("x")).select("doc_id", "u", F.col("x.keys").alias("key"), F.col("x.places").alias("place"))
    shared = save(spots.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key"), "shared-anchors")
    met = spots.join(shared, "key").groupBy("doc_id", "u").agg(F.collect_set(F.struct("key", "place")).alias("spots"))

    def same(batches):
        for batch in batches:
            fits = [first_bits(hashlib.sha256(b" ".join(x.as_py().encode("utf-8", "replace").split())).digest()) == u for x, u in zip(batch.column("text"), batch.column("u").to_pylist(), strict=True)]
            yield batch.filter(pa.array(fits, pa.bool_()))

    joined = docs.join(met, "doc_id").select("doc_id", "u", "text", "spots")
    candidates = save(joined.mapInArrow(same, joined.schema), "candidates")
    held = save(passages(candidates, window, anchor), "passages")
    widest = [F.lit(anchor - window).cast("long").alias("low"), F.lit(0).cast("long").alias("high")]
    found = save(distinct(held.select("key", "p1", "p2", F.col("doc_id").alias("least"), F.col("doc_id").alias("most"), "spot", *widest, "words")), "passages-distinct")
    runs = owned_runs(found, window, shard, group)
    smaller = F.filter("runs", lambda r: r["owner"] < F.col("doc_id"))
    cover = F.transform(smaller, lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + window).alias("b")))
    spans = held.select("doc_id", "u", "key", "p1", "p2", "start").join(runs, ["key", "p1", "p2"]).select("doc_id", "u", cover.alias("spans")).where(F.size("spans") > 0)
    spans = spans.groupBy("doc_id", "u").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    cut = save(cut_texts(candidates.join(spans, ["doc_id", "u"]).select("doc_id", "u", "text", "spans")).dropDuplicates(["doc_id", "u"]), "cut")
    marked = facts.select("doc_id", "u", "n_words", "sha").join(copies.withColumn("copy", F.lit(True)), ["doc_id", "u"], "left")
    marked = marked.join(cut.select("doc_id", "u", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("cut_sha")), ["doc_id", "u"], "left")
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha", "sha"))
    return marked.select("doc_id", "n_words", removed.alias("n_removed"), sha.alias("kept_sha256")), cut.select("doc_id", "kept")
