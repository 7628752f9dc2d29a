"""Hierarchical multi-length packing of token pieces."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import texts
from .workspace import save

LENGTH = 2048
TIERS = (256, 512, 1024, 2048)
END = 1
#: About so many pieces are packed by one task.
BLOCK = 10_000
#: Windows of the longest tier that a step group is worth.
GROUP = 64
#: A gap of so many tokens in a window of the longest tier is padded and not filled by cutting a piece.
SLACK = 8
#: Words encoded by one call.
LOT = 256


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts. Ids of whitespace-free stretches are kept by stretch, as no token of this vocabulary spans ASCII white space."""

    def __init__(self, path: str, most: int = 800_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.kind = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.start, self.long = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.kind)

    def _ids(self, words: list[str]) -> list:
        """The ids of each word. Words of letters alone are encoded many at once and told apart by the vocabulary's word ends; a
        lot whose ends don't match its words is encoded word by word, like all other stretches."""
        out: list = [None] * len(words)
        letters = [i for i, w in enumerate(words) if w.isalpha()]
        lots = [letters[i : i + LOT] for i in range(0, len(letters), LOT)]
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast([" ".join(words[i] for i in lot) for lot in lots], add_special_tokens=False), strict=True):
            flat = np.array(e.ids, np.int64)
            ends = np.flatnonzero(self.ends[flat]) + 1
            if len(ends) == len(lot) and ends[-1] == len(flat):
                for i, part in zip(lot, np.split(flat, ends[:-1]), strict=True):
                    out[i] = part.tolist()
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _numbers(self, t, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each stretch in the memory, which learns the new ones. Stretches are told apart by 64-bit hashes."""
        hashes, at, inverse = np.unique(t.spans(start, end, lower=True), return_index=True, return_inverse=True)
        number = np.array([self.known.get(h, -1) for h in hashes.tolist()], np.int64)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            if len(self.known) + len(fresh) > self.most and self.known:
                self.clear()
                return self._numbers(t, start, end)
            ids = self._ids([t.data[a:b].tobytes().lower().decode("utf-8", "replace") for a, b in zip(start[at[fresh]].tolist(), end[at[fresh]].tolist(), strict=True)])
            long = np.fromiter(map(len, ids), np.int64, len(ids))
            number[fresh] = np.arange(len(self.known), len(self.known) + len(fresh))
            self.known.update(zip(hashes[fresh].tolist(), number[fresh].tolist(), strict=True))
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(long) - long]
            self.long = np.r_[self.long, long]
            self.flat = np.r_[self.flat, np.fromiter((x for i in ids for x in i), self.kind, int(long.sum()))]
        return number[inverse]

    def encode(self, t) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, with END after each text, and where each text's ids start (one more at the end)."""
        start, end, count = t.letters_end()
        number = self._numbers(t, start, end) if len(start) else np.zeros(0, np.int64)
        long, begin = self.long[number], self.start[number]
        upto = np.cumsum(long)
        ids = self.flat[np.repeat(begin - (upto - long), long) + np.arange(int(long.sum()))] if len(number) else np.zeros(0, self.kind)
        ends = np.r_[0, upto][np.cumsum(count)]
        return np.insert(ids, ends, END), np.r_[0, ends + np.arange(1, t.n + 1)]


def token_pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (packed) of pieces of at most `length` ids; a document is cut at multiples of `length`."""
    path = path or tokenizer_path()

    def run(batches):
        encoder = Encoder(path)
        wide = encoder.kind.itemsize
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b, t in texts(batch.column("text"), 2 << 20):
                flat, at = encoder.encode(t)
                total = np.diff(at)
                parts = -(-total // length)
                doc = np.repeat(np.arange(t.n), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * length
                cuts = np.r_[at[:-1][doc] + start, len(flat)]
                body = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((cuts * wide).astype(np.int32)), pa.py_buffer(flat)])
                columns = [ids[a:b][doc], start, np.diff(cuts), total[doc]]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in columns], body], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


class Supply:
    """Pieces (number, first token) by length, sorted within each tier."""

    def __init__(self, tiers):
        self.tiers, self.levels, self.bins = tiers, {t: [] for t in tiers}, {}

    def tier(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def add(self, n: int, piece: tuple[int, int]) -> None:
        if n not in self.bins:
            self.bins[n] = []
            insort(self.levels[self.tier(n)], n)
        self.bins[n].append(piece)

    def _take(self, tier: int, k: int) -> tuple[int, int, int]:
        n = self.levels[tier][k]
        piece = self.bins[n].pop()
        if not self.bins[n]:
            del self.bins[n]
            self.levels[tier].pop(k)
        return (*piece, n)

    def longest(self, tier: int, room: int):
        """The longest piece of a tier that fits, or None: (number, first token, length)."""
        k = bisect_right(self.levels[tier], room)
        return self._take(tier, k - 1) if k else None

    def shortest(self, tier: int, over: int):
        """The shortest piece of a tier that is longer than `over`, or None."""
        k = bisect_right(self.levels[tier], over)
        return self._take(tier, k) if k < len(self.levels[tier]) else None


def pack_block(long: np.ndarray, size: int = LENGTH, tiers=TIERS, slack: int = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Windows of several lengths: rows (piece, first token, length, window, offset), and the tier of each window.

    A piece is routed to the shortest tier that holds it. Every second piece of the shorter tiers is set aside to fill longer windows;
    what they don't use comes back to its tier. From the longest tier down, each piece of a tier opens a window, whose gap takes the
    longest pieces that fit from the shorter tiers (in the shortest tier: from itself). A gap that is left is closed with the head of a
    longer piece, whose tail goes back to its tier; so windows of shorter tiers are exactly full. The last ones that can't be
    are packed into windows of `size`, which alone are padded.
    """
    own, spare, made, rest = Supply(tiers), Supply(tiers), [], []
    for rank, i in enumerate(np.argsort(long, kind="stable").tolist()):
        n = int(long[i])
        (spare if rank % 2 and n <= tiers[-2] else own).add(n, (i, 0))
    for at in range(len(tiers) - 1, -1, -1):
        tier, shorter = tiers[at], tiers[:at][::-1]
        while x := spare.longest(tier, tier):
            own.add(x[2], x[:2])
        while x := own.longest(tier, tier):
            held, room = [x], tier - x[2]
            while room and (x := own.longest(tier, room) if not at else next((y for t in shorter if (y := spare.longest(t, room))), None)):
                held.append(x)
                room -= x[2]
            if room and (at < len(tiers) - 1 or room > slack):
                donors = [(s, t) for s, some in ((spare, shorter), (own, shorter), (own, (tier,))) for t in reversed(some)]
                if x := next((y for s, t in donors if (y := s.shortest(t, room))), None):
                    held.append((x[0], x[1], room))
                    own.add(x[2] - room, (x[0], x[1] + room))
                    room = 0
            if room and at < len(tiers) - 1:
                rest += held
            else:
                made.append((tier, held))
    rooms: list[tuple[int, int]] = []
    for x in sorted(rest, key=lambda x: -x[2]):
        k = bisect_left(rooms, (x[2], -1))
        if k == len(rooms):
            made.append((size, [x]))
            insort(rooms, (size - x[2], len(made) - 1))
        else:
            room, w = rooms.pop(k)
            made[w][1].append(x)
            insort(rooms, (room - x[2], w))
    rows = []
    for w, (_, held) in enumerate(made):
        offset = 0
        for i, first, n in held:
            rows.append((i, first, n, w, offset))
            offset += n
    return np.array(rows, np.int64).reshape(-1, 5), np.array([t for t, _ in made], np.int64)


def step_groups(tier: np.ndarray, filled: np.ndarray, size: int = LENGTH) -> np.ndarray:
    """A step group of each window: windows are dealt to and fro, long and full ones first, so that groups hold about equal tokens."""
    groups = max(1, int(tier.sum()) // (GROUP * size))
    rank = np.empty(len(tier), np.int64)
    rank[np.lexsort((-filled, -tier))] = np.arange(len(tier))
    turn, place = rank // groups, rank % groups
    return np.where(turn % 2 == 0, place, groups - 1 - place)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """Packs all documents into sequences of at most `length` tokens: one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the window's length) and step_group. Null and empty
    texts are the end id alone; long texts are cut at multiples of `length`, and any piece may be cut once more to close a gap. Rows
    that share a doc_id, equal or not, are packed each. Rows with a null doc_id are left out; columns other than doc_id and text are
    ignored. An empty table gives an empty result. A block is a hash range of pieces, so no task sees more than a few blocks.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cut = save(token_pieces(docs, path, length), "pieces")
    blocks = max(1, -(-cut.count() // block))
    tiers = tuple(t for t in TIERS if t < length) + (length,)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("doc_tokens", "ascending")])
        long, body = table["length"].to_numpy(), table["ids"].combine_chunks()
        rows, tier = pack_block(long, length, tiers)
        piece, first, some, window, offset = rows.T
        filled = np.bincount(window, weights=some, minlength=len(tier)).astype(np.int64)
        base = int(table["block"][0].as_py()) << 32
        crc = np.zeros(len(rows), np.int64)
        for k, (i, a, n) in enumerate(rows[:, :3].tolist()):
            packed = body[i].as_buffer()
            crc[k] = zlib.crc32(np.frombuffer(packed, "<u2" if packed.size == 2 * long[i] else "<u4")[a : a + n].astype("<u4").tobytes())
        column = lambda c: table[c].to_numpy()[piece]
        out = {"doc_id": column("doc_id"), "start": column("start") + first, "length": some, "ids_crc32": crc, "doc_tokens": column("doc_tokens"), "sequence_id": base + window, "offset": offset, "tier": tier[window], "step_group": base + step_groups(tier, filled, length)[window]}
        return pa.table({k: pa.array(v.astype(np.int64)) for k, v in out.items()})

    placed = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens"), F.lit(blocks)))
    return placed.groupBy("block").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long")
