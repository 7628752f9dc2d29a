"""Small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import gzip
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import fingerprints, kernels, lines, mixing, neardup, packing, scoring, search, substrings, toxicity, warc

WORDS = [f"w{i}" for i in range(400)]


def passage(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


BASE = passage(1, 120)
TEXTS = {
    0: BASE, 1: BASE, 2: BASE.replace("w7 ", "other "), 3: None, 4: "", 5: "   \n\t ", 6: passage(2, 60) + " " + BASE[:400], 7: "one", 8: "One",
    9: "Repeated line here!\nshort\n  REPEATED line here!\t\nÄhnliche Zeile", 10: "Repeated line here!\nähnliche Zeile\nÄhnliche Zeile", 11: passage(3, 6000), 12: "ü " * 60, 13: "ü " * 70, 14: passage(1, 120) + "\x0bend",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, "x", 1) for i, t in TEXTS.items()] + [(None, "no id", "en", "s0", 1, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, size int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return (t or "").encode().split()


def test_kernels():
    import pyarrow as pa

    column = pa.array(["a bb", None, "", " c\x0bd\x1fe ", "ü x"] * 3)
    for most in (1, 7, 1 << 20):
        got = []
        for _, _, t in kernels.texts(column, most):
            got += [[t.data[s:e].tobytes() for s, e in zip(t.start[t.first[i] : t.first[i + 1]], t.end[t.first[i] : t.first[i + 1]], strict=True)] for i in range(t.n)]
        assert got == [words(x) for x in column.to_pylist()]
    h = [next(iter(kernels.texts(pa.array(["Abc abc abc", "abc"]))))[2].hashes(lower=low) for low in (False, True)]
    assert len(set(h[0].tolist())) == 2 and len(set(h[1].tolist())) == 1


def test_fingerprints(spark, docs, empty):
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    ids = sorted(TEXTS)
    assert sorted(got) == ids and fingerprints.fingerprint_edits(empty).count() == 0
    for k, i in enumerate(ids):
        a, b = TEXTS[i] or "", TEXTS[ids[(k + 1) % len(ids)]] or ""
        n = len(a) // 4
        assert got[i].n_chars == len(a) and got[i].edited_sha256 == hashlib.sha256((a[: len(a) - n] + b[:n]).encode()).hexdigest()
        other = got[ids[(k + 1) % len(ids)]].fingerprint
        assert got[i].near_next == 1 - bin(int(got[i].fingerprint, 16) ^ int(other, 16)).count("1") / 64
    assert got[0].fingerprint == got[1].fingerprint and got[3].fingerprint == "0" * 16
    lone = fingerprints.fingerprint_edits(docs.where("doc_id = 7")).first()
    assert lone.near_next == 1.0
    assert fingerprints.fingerprint_edits(docs.union(docs)).count() == 2 * len(TEXTS)


def test_permuted_tables(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 30)]
    values = sorted({b ^ sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for b in base for d in (0, 1, 2, 3, 4)})
    df = spark.createDataFrame([(f"{v:016x}",) for v in values] + [(f"{values[0]:016x}",), (None,)], "fingerprint string")
    got = {(r.a, r.b, r.distance) for r in fingerprints.near_pairs(df, 3).collect()}
    want = {(f"{a:016x}", f"{b:016x}", d) for a in values for b in values if a < b and (d := bin(a ^ b).count("1")) <= 3}
    assert got == want


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k", [4, 5])
def test_near_components(docs, empty, k):
    sets = {i: shingles(t, k) for i, t in TEXTS.items()}
    comp = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_components(docs, shingle=k).collect()}
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}
    if k == 5:
        assert neardup.near_components(empty).count() == 0
        assert neardup.near_components(docs.union(docs)).count() == 2 * len(TEXTS)


def test_chains_need_the_last_round(spark):
    """A chain of edits: neighbours are linked, the ends aren't, and no single hub links all."""
    text = passage(9, 200).split()
    rows = []
    for i in range(12):
        rows.append((i, " ".join(text), "x"))
        text = text[:]
        for k in range(3):
            text[(i * 13 + k * 67) % 200] = f"new{i}x{k}"
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.component_id for r in neardup.near_components(df).collect()} == {0}


def test_top_k(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 8))
    v[200:260] = v[0]
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)] + [(1000, None, 1), (1100, [1.0, None], 1), (1200, [float("nan")] * 8, 1), (1300, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in search.top_k(df).collect())
    m = np.floor(v.astype(np.float32).astype(float) * 1024).astype(int)
    ids = [*range(600), 1300]
    m = np.vstack([m, np.zeros((1, 8), int)])
    want = []
    for k, q in enumerate(ids):
        if q % 100 == 0:
            s = m @ m[k]
            best = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:10]
            want += [(q, n + 1, ids[j], int(s[j])) for n, j in enumerate(best)]
    assert got == sorted(want)
    assert search.top_k(df.limit(0)).count() == 0
    assert search.top_k(df.where("vec_id in (0, 1, 2)")).count() == 2


def test_top_k_of_repeated_ids(spark):
    """Rows that share an id are queries each; of equal rows a query takes only one, its own, away."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [0.5, 0.5]), (2, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in search.top_k(df).collect())
    want = Counter()
    for i, (a, q) in enumerate(rows):
        if a == 0:
            best = sorted((-sum(int(x * 1024) * int(y * 1024) for x, y in zip(q, v, strict=True)), b) for j, (b, v) in enumerate(rows) if j != i)
            want.update((0, n + 1, b, -s) for n, (s, b) in enumerate(best))
    assert got == want


def test_top_k_eliminates(spark):
    """Clustered vectors: few pairs are scored, and the result is that of all."""
    rng = np.random.default_rng(12)
    centre = rng.normal(size=(40, 24))
    x = (centre[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 24)) * 0.05) * rng.uniform(0.9, 1.1, (6000, 1))
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    told = {}
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in search.top_k(df, told=told).collect())
    m = np.floor(x * 1024).astype(np.int64)
    want = []
    for q in range(0, 6000, 100):
        s = m @ m[q]
        want += [(q, n + 1, int(j), int(s[j])) for n, j in enumerate([j for j in np.lexsort((np.arange(6000), -s))[:11] if j != q][:10])]
    assert got == want and told["pairs"] == 360_000 and told["scored"] < 0.1 * told["pairs"], told


def test_warc(spark, tmp_path):
    big, twin = "ß<p>\r\n\r\n" * 9000, "same page " * 200
    rows = [(1, "http://a/\r\nx", "small"), (2, None, big), (3, "http://b", twin), (4, "http://c", twin), (5, "u", None), (6, "u", ""), (7, "u", "small"), (8, "v", twin), (8, "v", twin), (None, "v", "x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    want = {i: (len(b := (h or "").encode()), hashlib.sha1(b).hexdigest(), "revisit" if h == twin and i != 8 else "response", 8 if h == twin and i != 8 else None) for i, _, h in rows if i}
    assert got == want and warc.round_trip(df).count() == 8 and warc.round_trip(df.limit(0)).count() == 0
    records = [next(iter(warc.parse(x + b"\r\n\r\n"))) for x in warc.page_records(2, None, big.encode(), None)]
    assert len(records) >= 5 and records[-1][0]["warc-segment-total-length"]
    warc.write_archives(df, f"{tmp_path}/archives")
    for file in tmp_path.glob("archives/part-*"):
        rest = file.read_bytes()
        while rest:
            one = zlib.decompressobj(31)
            assert len(list(warc.parse(one.decompress(rest)))) == 1 and one.eof
            rest = one.unused_data
    long = bytes(range(256)) * 300
    assert gzip.decompress(warc.member(long, 10_000)) == long + b"\r\n\r\n" and warc.member(long)[-1] == 0
    assert warc.unchunked(b"4;x=1\r\nWiki\r\n0\r\nT: 1\r\n\r\n") == b"Wiki"
    with pytest.raises(ValueError):
        warc.unchunked(b"9\r\nWiki\r\n")


def test_scores_both_sides(spark, docs, empty):
    ordered = " ".join(["red", "green", "blue", "black"] * 60)
    mixed = " ".join(np.random.default_rng(2).permutation(ordered.split()))
    rows = [(i, ordered) for i in range(60)] + [(60, mixed), (61, ordered), (62, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in scoring.score_documents(df).collect()}
    assert got[61].mean_log_prob > got[60].mean_log_prob and got[62].log_prob == 0 and got[62].mean_log_prob is None
    assert got[0].n_words == 240 and scoring.score_documents(docs).count() == len(TEXTS) and scoring.score_documents(empty).count() == 0


def small_net(seed=3):
    rng = np.random.default_rng(seed)
    return {k: rng.normal(size=v.shape) * 0.3 for k, v in scoring.initial(3).items()}


def brute_log_probability(net, words, i):
    """Of word i of a text, by definition."""
    pad, reach = len(net["embed"]) - 1, scoring.REACH
    total, k = net["bias"].copy(), 0
    for o in range(-reach, reach + 1):
        if o:
            total += net["embed"][words[i + o] if 0 <= i + o < len(words) else pad] * net["place"][k]
            k += 1
    h, out = np.r_[np.tanh(total), 1], 0.0
    for d, (node, child) in enumerate([(0, words[i] // 3), (words[i] // 3, words[i] % 3)]):
        logits = h @ net[f"level{d}"][node]
        out += logits[child] - np.log(np.exp(logits).sum())
    return out


def test_log_probabilities_by_definition():
    net, rng = small_net(), np.random.default_rng(4)
    parts = [rng.integers(0, 9, n) for n in (5, 0, 1, 30)]
    at = np.r_[0, np.cumsum([len(x) for x in parts])]
    seq, where = scoring.sequence(np.concatenate(parts), at, 9)
    got = np.concatenate([scoring.log_probabilities(net, seq[a:b], some - a) for some, a, b in scoring.pieces(where, 7)])
    want = [brute_log_probability(net, x.tolist(), i) for x in parts for i in range(len(x))]
    assert np.allclose(got, want)
    assert np.isclose(sum(np.exp(brute_log_probability(net, [1, w, 2], 1)) for w in range(9)), 1)
    large = net | {"level1": net["level1"] * 100}
    assert not scoring.small(large) and np.allclose(scoring.log_probabilities(large, seq, where)[:5], [brute_log_probability(large, parts[0].tolist(), i) for i in range(5)])


def test_gradients_by_differences():
    net, rng = small_net(), np.random.default_rng(6)
    seq, where = scoring.sequence(rng.integers(0, 9, 25), np.array([0, 10, 25]), 9)
    grad, step = scoring.gradients(net, seq, where), 1e-5
    for k, v in net.items():
        for at in rng.choice(v.size, min(v.size, 12), replace=False):
            old, loss = v.flat[at], []
            for d in (step, -step):
                v.flat[at] = old + d
                loss.append(-scoring.log_probabilities(net, seq, where).sum())
            v.flat[at] = old
            assert np.isclose(grad[k].flat[at], (loss[0] - loss[1]) / (2 * step), atol=1e-5), (k, at)


def test_scores_hang_on_no_partitioning(spark):
    rows = [(i % 90, " ".join(np.random.default_rng(i).choice(WORDS[:60], 150))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((r.doc_id, r.log_prob) for r in scoring.score_documents(df.repartition(n)).collect()) for n in (1, 8)]
    assert [x[0] for x in got[0]] == [x[0] for x in got[1]] and np.allclose([x[1] for x in got[0]], [x[1] for x in got[1]], atol=1e-2)


def brute_windows(texts, n):
    first, out = {}, {}
    for i in sorted(texts):
        w = words(texts[i])
        for a in range(len(w) - n + 1):
            first.setdefault(tuple(w[a : a + n]), i)
    for i, t in texts.items():
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - n + 1):
            if first[tuple(w[a : a + n])] < i:
                gone[a : a + n] = [True] * n
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("group", [1000, 1])
def test_windows(docs, empty, group):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_windows(docs, group=group)[0].collect()}
    assert got == brute_windows(TEXTS, 50)
    if group == 1:
        assert substrings.dedup_windows(empty)[0].count() == 0
        assert substrings.dedup_windows(docs.union(docs))[0].count() == 2 * len(TEXTS)


def test_windows_of_near_copies(spark):
    """Near copies, each with edits of its own: groups are halved, down to single windows, and nothing is lost."""
    rng, base = np.random.default_rng(8), passage(77, 300).split()
    texts = {}
    for i in range(60):
        w = base[:]
        for k in rng.choice(300, rng.integers(0, 8), replace=False):
            w[k] = f"edit{i % 25}x{k}"
        texts[i] = " ".join(w[int(rng.integers(0, 20)) :])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for group in (3, 10, 1000):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_windows(df, group=group, shard=50)[0].collect()}
        assert got == brute_windows(texts, 50), group


def test_windows_of_repeated_ids(spark):
    """Two texts of one id: each loses what a smaller id holds, and nothing for the other's sake."""
    a, b = passage(5, 70), passage(6, 70)
    df = spark.createDataFrame([(1, a), (5, a + " tail"), (5, b), (5, b + " more"), (9, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup_windows(df)[0].collect())
    assert got == [(1, 70, 0), (5, 70, 0), (5, 71, 0), (5, 71, 70), (9, 70, 70)]


def test_fm_index():
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 3, n) for n in (30, 7, 40, 12, 3)]
    at, flat = np.r_[0, np.cumsum([len(p) for p in parts])], np.concatenate(parts)
    index = substrings.FMIndex(flat, at, np.array([5, 2, 9, 1, 0]), 5)
    tree = substrings.WaveletTree(flat, 2)
    pos = rng.integers(0, len(flat) + 1, 50)
    sym = rng.integers(0, 3, 50)
    assert tree.rank(sym, pos).tolist() == [int((flat[:p] == s).sum()) for s, p in zip(sym, pos, strict=True)]
    ask = [rng.integers(-1, 3, n) for n in (25, 4, 5, 60)]
    got = substrings.window_owners(np.concatenate(ask), np.r_[0, np.cumsum([len(p) for p in ask])], index)
    want = []
    for q in ask:
        for i in range(len(q)):
            w = q[i : i + 5].tolist()
            own = [o for p, o in zip(parts, [5, 2, 9, 1, 0], strict=True) if len(w) == 5 and any(p[j : j + 5].tolist() == w for j in range(len(p) - 4))]
            want.append(min(own, default=np.iinfo(np.int64).max))
    assert got.tolist() == want


def test_lines(docs, empty):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    first = {}
    for i in sorted(TEXTS):
        for x in (TEXTS[i] or "").split("\n"):
            first.setdefault(key(x), i)
    want = {}
    for i, t in TEXTS.items():
        x = (t or "").split("\n")
        kept = [y for y in x if len(key(y)) < 10 or first[key(y)] == i]
        want[i] = ("\n".join(kept), len(x), len(x) - len(kept))
    for batches in (1, 4):
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(docs, batches=batches).collect()}
        assert got == want
    assert lines.dedup_lines(empty).count() == 0


def test_runs_are_compacted(spark):
    runs = lines.Runs(spark, fanout=2)
    for i in range(5):
        runs.add(runs.write(spark.range(i * 10, i * 10 + 10).selectExpr("id as h1", "id as h2"), dealt=False))
    assert [len(x) for x in runs.levels] == [1, 0, 1] and sorted(r.h1 for t in runs.tables() for r in t.collect()) == list(range(50))
    runs.drop()


def test_runs_are_not_dealt_or_sorted_again(spark):
    runs = lines.Runs(spark)
    name = runs.write(spark.range(100).selectExpr("id as h1", "id as h2"), dealt=False)
    spark.conf.set(lines.ORDERED, "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        other = spark.range(50, 150).selectExpr("id as h1", "id as h2", "1 as seen").groupBy("h1", "h2").agg(F.max("seen"))
        plan = other.join(spark.table(name), lines.KEY, "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(lines.ORDERED)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        runs.drop()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and "SortMergeJoin" in plan


def test_lines_of_repeated_ids(spark):
    """Rows of one id with different texts lose their own lines only."""
    rows = [(1, "common line here\nmine alone here"), (5, "common line here\nfive"), (5, "kept other text\nzzz"), (5, "kept other text\nzzz"), (9, "kept other text")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, row string, pos int")
    got = sorted((r.doc_id, r.text, r.row) for r in lines.dedup_lines(df, keep=["row"]).collect())
    assert got == [(1, rows[0][1], "x"), (5, "five", "x"), (5, "kept other text\nzzz", "x"), (5, "kept other text\nzzz", "x"), (9, "", "x")]


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS) and mixing.mix(empty).count() == 0
    source = {r.doc_id: r.source for r in docs.collect()}
    size = Counter()
    for r in got:
        assert r["size"] == len(words(TEXTS[r.doc_id])) and 0 <= r.taken <= 2 * r["size"]
        size[source[r.doc_id]] += r["size"]
    weight = dict(zip(["s0", "s1", "s2", None], (5, 2, 1, 5), strict=True))
    left, rest, target = set(weight), 1.5 * sum(size.values()), {}
    while left:
        w = sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / w > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in over} if over else {s: rest * weight[s] / w for s in left}
        rest -= sum(target[s] for s in over)
        left = left - over if over else set()
    for r in got:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == size[source[r.doc_id]]
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs).collect()))
    many = spark.range(4000).selectExpr("id as doc_id", "repeat('a ', cast(pmod(xxhash64(id), 300) as int)) as text", "concat('s', cast(id % 3 as string)) as source")
    taken, want = defaultdict(int), {}
    for r in mixing.mix(many).collect():
        taken[r.doc_id % 3] += r.taken
        want[r.doc_id % 3] = r.target
    assert all(abs(taken[k] - want[k]) <= 5 for k in want)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    odd = {20: "don't stop.,, A.B, 3,4 <|endoftext|>, É́ ΣΑΣ, x.", 21: "n't, 's."}
    more = docs.select("doc_id", "text").where("doc_id is not null").union(docs.sparkSession.createDataFrame(list(odd.items()), "doc_id long, text string"))
    rows = packing.pack(more).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    for i, t in {**TEXTS, **odd}.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(ids[at : at + r.length].tobytes()), len(ids)), i
            at += r.length
        assert at == len(ids)
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(empty).count() == 0


def test_pack_block_makes_windows_of_all_tiers():
    long = np.minimum(np.random.default_rng(6).lognormal(6, 1, 5000).astype(int) + 1, 2048)
    rows, tier = packing.pack_block(long)
    filled = np.bincount(rows[:, 3], weights=rows[:, 2])
    assert set(tier) == set(packing.TIERS) and (filled <= tier).all() and (filled == tier)[tier < 2048].all()
    assert 1 - filled.sum() / tier.sum() < 0.005
    by = defaultdict(list)
    for i, first, n, _, _ in rows.tolist():
        by[i].append((first, n))
    for i, parts in by.items():
        at = 0
        for first, n in sorted(parts):
            assert first == at and n > 0
            at += n
        assert at == long[i]
    assert len(by) == len(long)
    group = packing.step_groups(tier, filled)
    tokens = np.bincount(group, weights=filled)
    assert len(tokens) > 10 and tokens.max() - tokens.min() <= 2 * 2048
    for few in ([], [1], [2048], [300, 300], [2047, 2047, 1]):
        rows, tier = packing.pack_block(np.array(few, np.int64))
        assert sum(rows[:, 2]) == sum(few) and all(t == 2048 or t == f for t, f in zip(tier, np.bincount(rows[:, 3], weights=rows[:, 2], minlength=len(tier)), strict=True))


def test_scan_finds_segments():
    score = np.array([-1, 2, -1, 3, -5, 4, -1, -1, 1, -9, 2.0, 5])
    found = toxicity.scan(score, np.array([0] * 10 + [1] * 2))
    best = {tuple(map(int, x[:2])): x[2] for x in found}
    assert best[1, 3] == 4 and best[5, 5] == 4 and best[10, 11] == 7 and best[8, 8] == 1
    assert len(toxicity.scan(np.zeros(0), np.zeros(0, int))) == 0


def test_scan_against_its_definition():
    """The best segment (of equals the first that ends, and then the shortest), and then those to its left and to its right."""

    def by_definition(s, at):
        sums = [(s[i : j + 1].sum(), -j, i) for i in range(len(s)) for j in range(i, len(s))]
        if not sums or max(sums)[0] <= 0:
            return []
        total, j, i = max(sums)
        return [*by_definition(s[:i], at), (at + i, at - j, total), *by_definition(s[1 - j :], at - j + 1)]

    random = np.random.default_rng(5)
    for k in range(150):
        long = random.integers(0, 30, 3)
        score = (random.integers(-4, 5, long.sum()) if k % 2 else np.round(random.normal(-0.2, 1, long.sum()) * 16) / 16).astype(float)
        cut = np.cumsum(long)
        want = [x for a, b in zip(cut - long, cut, strict=True) for x in by_definition(score[a:b], a)]
        assert [tuple(x) for x in toxicity.scan(score, np.repeat(np.arange(3), long))] == want
    falls = lambda n: np.stack([np.arange(n, 0.0, -1), 0.5 - np.arange(n, 0.0, -1)], 1).ravel()
    assert len(toxicity.scan(falls(50_000), np.zeros(100_000, int))) > 0  # nested swings, where rescans would take the square


def test_toxicity(spark, docs, empty):
    bad = lambda i: passage(i, 80) + " idiot moron scum idiot " + passage(i + 1, 20)
    texts = [(100 + i, bad(i) if i % 4 == 0 else passage(1000 + i, 100)) for i in range(400)] + [(7, None), (8, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(100 + i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, labels).collect()}
    wrong = sum(got[100 + i].predicted != int(i % 4 == 0) for i in range(400))
    assert wrong <= 4 and got[7].predicted == 0 and got[7].score == got[8].score
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0)).agg(F.max("predicted")).first()[0] == 0


def test_prefix_pairs_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, 300)
    sets = [np.unique(np.r_[rng.choice(base, int(300 * keep), replace=False), rng.integers(-(1 << 62), 1 << 62, new)]) for keep, new in zip(rng.uniform(0.75, 1, 60), rng.integers(0, 80, 60), strict=True)]
    sets += [np.unique(rng.integers(-(1 << 62), 1 << 62, 5)), sets[0][:1]]
    frame = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, packed binary")
    rest = spark.createDataFrame([(i, i) for _ in (1, 2) for i in range(len(sets))], "id long, comp long")
    got = {frozenset(r) for r in neardup.prefix_pairs(rest, frame).collect()}
    near = set()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                near.add(frozenset((i, j)))
    assert near and near <= got
    assert len(got) < len(sets) * (len(sets) - 1) / 4
    assert neardup.prefix_pairs(rest.where("id < 0"), frame).isEmpty()
    two = {i: int(i % 7 == 0) for i in range(len(sets))}
    rest = spark.createDataFrame(list(two.items()), "id long, comp long")
    got = {frozenset(r) for r in neardup.prefix_pairs(rest, frame).collect()}
    assert {x for x in near if len({two[i] for i in x}) == 2} <= got and all(len({two[i] for i in x}) == 2 for x in got)


@pytest.mark.parametrize("rounds", [0, 2])
def test_links_of_repeated_ids(spark, rounds):
    """Rows that share an id but not their text are linked by their own sets."""
    a, b = passage(21, 100), passage(22, 100)
    rows = [(5, a, "p"), (5, b, "q"), (2, a + " end", "r"), (7, b + " end", "s"), (5, a, "t"), (9, "", "u"), (9, None, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, first string")
    got = {r.first: (r.component_id, r.kept) for r in neardup.near_components(df, rounds=rounds, keep=["first"]).collect()}
    assert got == {"p": (2, False), "q": (5, True), "r": (2, True), "s": (5, False), "t": (2, False), "u": (9, True), "v": (9, True)}
