"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy over all documents, predicts every word from both sides."""

from __future__ import annotations

import ctypes
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import signed, texts
from .workspace import save

#: Units are the leaves of a tree of DEPTH levels; CLASSES: children of a node at least. One unit in OTHER is a bucket of rarer words.
CLASSES, DEPTH, OTHER = 32, 2, 16
REACH, WIDTH = 4, 24
#: Rounds deal all documents among themselves, so every word is predicted once in training. SHARD: words that one task trains on, about.
ROUNDS, SHARD = 2, 2_000_000
#: BATCH: words of a step for each node of the lowest level.
RATE, BATCH = 0.15, 128
#: Parameter blocks of so many shards are added up by one task.
FAN = 64
#: Fixed values of glibc's malloc.h.
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3
#: Parameters are averaged as whole numbers of 1 / FIXED, so that sums do not hang on their order; BLOCK of them are a row.
FIXED, BLOCK = 1 << 20, 8192


def word_classes(distinct: int) -> int:
    """Children of a node: the units, classes**DEPTH, grow with the square root of the distinct words."""
    return max(CLASSES, math.ceil((4 * distinct**0.5) ** (1 / DEPTH)))


@dataclass(frozen=True)
class Vocabulary:
    """The units that the network predicts: the most frequent words in order, one each, and after them hash buckets of all other words."""

    classes: int
    #: hashes of the frequent words in order, and their units
    hashes: np.ndarray
    units: np.ndarray
    #: how often the words of each bucket are found in all documents
    totals: np.ndarray

    def settle(self, hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit of each word, and the log of the word's share of it; n: how often all documents hold the word."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        own = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        bucket = hashes % len(self.totals)
        unit = self.classes**DEPTH - len(self.totals) + bucket
        unit[own] = self.units[at[own]]
        share = np.zeros(len(hashes))
        share[~own] = np.log(n[~own] / self.totals[bucket[~own]])
        return unit, share


def cut(docs: DataFrame) -> DataFrame:
    """Runs of texts: a row with doc_ids, sizes and words (places in the run's list of words), and a row for each listed word (A-Z lower-cased) with hash and n."""

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        empty = lambda n, kind: pa.nulls(n, kind)
        many = pa.list_(pa.int64())
        for batch in batches:
            ids = batch.column("doc_id")
            for at, to, t in texts(batch.column("text"), 8 << 20):
                listed, words, n = np.unique(t.hashes(lower=True).view(np.int64), return_inverse=True, return_counts=True)
                one = lambda x: pa.array([x], many)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), one(ids.slice(at, to - at).to_pylist()), one(t.count), pa.array([words.astype(np.uint32).tobytes()], pa.binary()), empty(1, pa.int64()), empty(1, pa.int64())], NAMES)
                for i in range(0, len(listed), 100_000):
                    m = len(part := listed[i : i + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), empty(m, many), empty(m, many), empty(m, pa.binary()), signed(part), pa.array(n[i : i + m])], NAMES)
                chunk += 1

    return docs.select("doc_id", "text").mapInArrow(run, "chunk long, doc_ids array<long>, sizes array<long>, words binary, hash long, n long")


NAMES = ["chunk", "doc_ids", "sizes", "words", "hash", "n"]


def count_words(runs: DataFrame) -> DataFrame:
    """chunk, hash, n, first: each run's words with their numbers in all documents; first: in one run of those with the word."""
    whole = Window.partitionBy("hash")
    return runs.where("hash is not null").select("chunk", "hash", F.sum("n").over(whole).alias("n"), (F.min("chunk").over(whole) == F.col("chunk")).alias("first"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Words and buckets in numbers that grow with the distinct words, dealt to classes by frequency."""
    words = counts.where("first")
    classes = word_classes(words.count())
    other = classes**DEPTH // OTHER
    top = [tuple(r) for r in words.orderBy(F.desc("n"), "hash").limit(classes**DEPTH - other).select("hash", "n").collect()]
    hashes, n = np.array(top, np.int64).reshape(-1, 2).T
    totals = np.zeros(other, np.int64)
    for bucket, total in words.groupBy(F.expr(f"pmod(hash, {other})")).agg(F.sum("n")).collect():
        totals[bucket] = total
    np.subtract.at(totals, hashes % other, n)
    order = np.argsort(hashes)
    return Vocabulary(classes, hashes[order], order, totals)


def numbered(runs: DataFrame, counts: DataFrame, known: Vocabulary) -> DataFrame:
    """doc_id, the packed units of each whole text, and the sum of the logs of its words' shares of them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, n = (right.column(c).to_numpy() if right.num_rows else np.zeros(0, np.int64) for c in ("hash", "n"))
        order = np.argsort(hashes)
        unit, share = known.settle(hashes[order], n[order])
        ids, size = (left.column(c).combine_chunks().flatten() for c in ("doc_ids", "sizes"))
        size = size.to_numpy()
        words = np.frombuffer(left.column("words")[0].as_py(), np.uint32)
        at = np.r_[0, np.cumsum(size)]
        units = unit[words].astype(packing(known.classes))
        lost = np.bincount(np.repeat(np.arange(len(size)), size), weights=share[words], minlength=len(size)).astype(np.float64)
        return pa.table([ids, pa.array([units[at[i] : at[i + 1]].tobytes() for i in range(len(size))], pa.binary()), pa.array(lost)], ["doc_id", "words", "share"])

    whole = runs.where("hash is null").select("chunk", "doc_ids", "sizes", "words").groupBy("chunk")
    return whole.cogroup(counts.select("chunk", "hash", "n").groupBy("chunk")).applyInArrow(run, "doc_id long, words binary, share double")


def initial(classes: int, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    return {
        "embed": draw(classes**DEPTH + 1, WIDTH), "place": np.ones((2 * REACH, WIDTH), np.float32) / 2, "bias": np.zeros(WIDTH, np.float32),
        # The weights of each node of a level; their last row is the bias.
        **{f"level{d}": draw(classes**d, WIDTH + 1, classes) * 0.1 for d in range(DEPTH)},
    }


def packing(classes: int) -> np.dtype:
    """How units are packed."""
    return np.dtype("<u2" if classes**DEPTH < 1 << 16 else "<u4")


def sequence(units: np.ndarray, at: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The units of some texts in a row, with REACH pads around each text, and where the units lie. at: where each text starts, and the end."""
    where = np.arange(len(units)) + REACH * (np.repeat(np.arange(len(at) - 1), np.diff(at)) + 1)
    out = np.full(len(units) + REACH * len(at), pad, np.int64)
    out[where] = units
    return out, where


def hidden(net: dict, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The embeddings of a sequence, and the hidden state of each place but the first and last REACH, from the REACH places on both sides;
    its last component is 1."""
    every, n = net["embed"][seq], len(seq) - 2 * REACH
    total, part = np.repeat(net["bias"][None, :], n, axis=0), np.empty((n, every.shape[1]), every.dtype)
    for k, o in enumerate(OFFSETS):
        total += np.multiply(every[o : o + n], net["place"][k], out=part)
    out = np.ones((n, every.shape[1] + 1), every.dtype)
    np.tanh(total, out=out[:, :-1])
    return every, out


OFFSETS = [o for o in range(2 * REACH + 1) if o != REACH]


def exponentials(h: np.ndarray, weight: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the logits h @ weight: themselves, their exponentials and those' sums, all up to a factor unless they are small."""
    logits = h @ weight
    if not small:
        logits -= logits.max(axis=1, keepdims=True)
    out = np.exp(logits)
    return logits, out, out @ np.ones(out.shape[1], out.dtype)


def small(net: dict) -> bool:
    """h is a tanh, and so the weights bound the logits; below 60, their exponentials fit."""
    return max(np.abs(net[f"level{d}"]).sum(1).max() for d in range(DEPTH)) < 60


def nodes(unit: np.ndarray, classes: int):
    """Of sorted units: (level, node, first, end, child of each) for every node that some of them pass."""
    for d in range(DEPTH):
        node, child = np.divmod(unit // classes ** (DEPTH - 1 - d), classes)
        head = np.flatnonzero(np.r_[True, node[1:] != node[:-1]][: len(node)])
        for a, b, n in zip(head.tolist(), [*head[1:].tolist(), len(node)], node[head].tolist(), strict=True):
            yield f"level{d}", n, a, b, child[a:b]


def log_probabilities(net: dict, seq: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The log-probability of each unit at `where` in a sequence, given those on both sides."""
    classes, fits = net["level0"].shape[-1], small(net)
    order = np.argsort(seq[where].astype(packing(classes)), kind="stable")
    h, unit, row = hidden(net, seq)[1][where[order] - REACH], seq[where[order]], np.arange(len(where))
    out = np.zeros(len(unit), h.dtype)
    for level, n, a, b, child in nodes(unit, classes):
        logits, _, total = exponentials(h[a:b], net[level][n], fits)
        out[a:b] += logits[row[: b - a], child] - np.log(total)
    back = np.empty_like(out)
    back[order] = out
    return back


def gradients(net: dict, seq: np.ndarray, where: np.ndarray) -> dict[str, np.ndarray]:
    """The gradient of the sum of -log_probabilities(net, seq, where)."""
    classes, n, fits = net["level0"].shape[-1], len(seq) - 2 * REACH, small(net)
    every, full = hidden(net, seq)
    order = np.argsort(seq[where].astype(packing(classes)), kind="stable")
    place, unit, row = where[order] - REACH, seq[where[order]], np.arange(len(order))
    h = full[place]
    dh, grad = np.zeros_like(h), {f"level{d}": np.zeros_like(net[f"level{d}"]) for d in range(DEPTH)}
    for level, k, a, b, child in nodes(unit, classes):
        some = h[a:b]
        _, p, total = exponentials(some, net[level][k], fits)
        p /= total[:, None]
        p[row[: b - a], child] -= 1
        grad[level][k] = some.T @ p
        dh[a:b] += p @ net[level][k].T
    dz = np.zeros((n, h.shape[1] - 1), h.dtype)
    dz[place] = (dh * (1 - h * h))[:, :-1]
    grad["bias"], grad["place"] = np.ones(n, dz.dtype) @ dz, np.empty_like(net["place"])
    back, part = np.zeros_like(every), np.empty_like(dz)
    for k, o in enumerate(OFFSETS):
        grad["place"][k] = np.einsum("ij,ij->j", dz, every[o : o + n])
        back[o : o + n] += np.multiply(dz, net["place"][k], out=part)
    order = np.argsort(seq.astype(packing(classes)), kind="stable")
    key = seq[order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    grad["embed"] = np.zeros_like(net["embed"])
    grad["embed"][key[head]] = np.add.reduceat(back[order], head, axis=0)
    return grad


def keep_memory() -> None:
    """Has the C library keep arrays of a few MB for the next step, where it is glibc; else each step pays for fresh pages."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(M_MMAP_THRESHOLD, 64 << 20)
        mallopt(M_TRIM_THRESHOLD, 128 << 20)


def train_step(net: dict, memory: dict, seq: np.ndarray, where: np.ndarray) -> None:
    """One Adagrad step on the mean of a batch."""
    grad = gradients(net, seq, where)
    for k, g in grad.items():
        g /= len(where)
        memory[k] += g * g
        net[k] -= RATE * g / (np.sqrt(memory[k]) + 1e-6)


def gathered(batches, kind: np.dtype, most_words: int = 400_000):
    """rows, all units, and where each text starts, of a few texts at a time."""
    for batch in batches:
        body = batch.column("words")
        size = np.array([len(x.as_buffer()) // kind.itemsize for x in body], np.int64)
        part = np.cumsum(size) // most_words
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            joined = b"".join(body[int(i)].as_py() for i in rows)
            yield batch.take(pa.array(rows)), np.frombuffer(joined, kind).astype(np.int64), np.r_[0, np.cumsum(size[rows])]


def pieces(where: np.ndarray, most: int):
    """where in runs of `most` places, each with the part of the sequence (first, end) that its windows reach."""
    for i in range(0, len(where), most):
        some = where[i : i + most]
        yield some, int(some[0]) - REACH, int(some[-1]) + REACH + 1


def added(rows: pa.Table) -> pa.Table:
    """The sums of some shards' values of one block of parameters."""
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("v"))
    return pa.table([rows.column("i").slice(0, 1), rows.column("slot").slice(0, 1), pa.array([total.tobytes()], pa.binary()), pa.array([int(rows.column("w").to_numpy().sum())])], ["i", "slot", "v", "w"])


def train(words: DataFrame, classes: int, rounds: int = ROUNDS, shard: int = SHARD) -> dict:
    """Rounds of local training and averaging. Documents are dealt to rounds and shards by a hash of id and content, and are sorted within
    a shard, so the parameters don't hang on partitions. Each shard steps through all its words from the shared parameters; the shards'
    parameters are averaged by their numbers of words, in whole numbers, FAN shards at a time."""
    net, kind = initial(classes), packing(classes)
    shapes = {k: v.shape for k, v in net.items()}
    total = words.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, -(-total // (kind.itemsize * rounds * shard)))
    dealt = words.select("doc_id", "words", F.xxhash64("doc_id", "words").alias("h"))
    schema = "i long, slot long, v binary, w long"
    for r in range(rounds):
        start = net

        def fit(rows: pa.Table) -> pa.Table:  # runs before start changes: save() below is eager
            keep_memory()
            own = {k: v.copy() for k, v in start.items()}
            memory = {k: np.full(v.shape, 1e-3, np.float32) for k, v in own.items()}
            rows = rows.sort_by([("h", "ascending"), ("doc_id", "ascending")])
            seen = 0
            for _, flat, at in gathered(rows.combine_chunks().to_batches(), kind, shard):
                seq, where = sequence(flat, at, classes**DEPTH)
                for some, a, b in pieces(where, BATCH * classes ** (DEPTH - 1)):
                    train_step(own, memory, seq[a:b], some - a)
                seen += len(flat)
            weight = -(-seen // 1024)
            flat = np.rint(np.concatenate([own[k].ravel() for k in shapes]).astype(np.float64) * FIXED).astype(np.int64) * weight
            parts = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)] if seen else []
            slot = int(rows["shard"][0].as_py()) // FAN
            return pa.table([pa.array(np.arange(len(parts))), pa.array(np.full(len(parts), slot)), pa.array(parts, pa.binary()), pa.array(np.full(len(parts), weight))], ["i", "slot", "v", "w"])

        chosen = dealt.where(F.pmod("h", F.lit(rounds)) == r).withColumn("shard", F.pmod(F.shiftright("h", 16), F.lit(shards)))
        sums, left = chosen.groupBy("shard").applyInArrow(fit, schema), -(-shards // FAN)
        sums = sums.groupBy("i", "slot").applyInArrow(added, schema)
        while left > 1:
            sums, left = save(sums, f"sums{r}-{left}"), -(-left // FAN)
            sums = sums.withColumn("slot", F.expr(f"slot div {FAN}")).groupBy("i", "slot").applyInArrow(added, schema)
        rows = save(sums, f"parameters{r}").orderBy("i").collect()
        if not rows:
            continue
        flat, at, fresh = np.concatenate([np.frombuffer(x["v"], np.int64) / x["w"] / FIXED for x in rows]).astype(np.float32), 0, {}
        for k, shape in shapes.items():
            fresh[k] = flat[at : at + int(np.prod(shape))].reshape(shape)
            at += int(np.prod(shape))
        net = fresh
    return net


def score(words: DataFrame, net: dict) -> DataFrame:
    """doc_id, n_words, log_prob: the sum of the log-probabilities of all words, each given those around it."""
    pad, classes = len(net["embed"]) - 1, net["level0"].shape[-1]
    kind = packing(classes)

    def run(batches):
        keep_memory()
        for rows, flat, at in gathered(batches, kind):
            seq, where = sequence(flat, at, pad)
            parts = [log_probabilities(net, seq[a:b], some - a) for some, a, b in pieces(where, 2 * BATCH * classes ** (DEPTH - 1))] or [np.zeros(0)]
            total = np.r_[0.0, np.cumsum(np.concatenate(parts).astype(np.float64))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(at)), pa.array(total[at[1:]] - total[at[:-1]] + rows.column("share").to_numpy())], ["doc_id", "n_words", "log_prob"])

    return words.mapInArrow(run, "doc_id long, n_words long, log_prob double")


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores every whole text by its masked pseudo-likelihood: doc_id, n_words, log_prob (sum, rounded to 4 places), mean_log_prob.

    The vocabulary counts cover all documents, and training predicts every word of them. Rarer words share buckets; the probability of
    such a word is its bucket's times the word's share of all occurrences in the bucket. Words and buckets grow with the square root of
    the distinct words. Texts without words (null or empty) have log_prob 0 and a null mean; texts are whole at any length. Rows with a
    null doc_id are left out; rows that share a doc_id, equal or not, are scored each. Other columns are ignored. An empty table gives
    an empty result.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    runs = save(cut(docs), "runs")
    counts = save(count_words(runs), "word-counts")
    known = vocabulary(counts)
    words = save(numbered(runs, counts, known), "numbered")
    scored = score(words, train(words, known.classes, rounds))
    return scored.select("doc_id", "n_words", F.round("log_prob", 4).alias("log_prob"), F.round(F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")), 6).alias("mean_log_prob"))
