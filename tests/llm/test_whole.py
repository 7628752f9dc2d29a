"""The whole job of the operators, where they once did a part of it."""

import math
from collections import defaultdict

import numpy as np

from quadrille.llm import kernels, scoring


def hashes(words):
    body = " ".join(words).encode()
    return kernels.Texts(np.frombuffer(body, np.uint8), np.array([0, len(body)])).hashes(lower=True).view(np.int64)


def test_rare_words_take_their_share_of_a_bucket(spark):
    often = {f"rare{i}": 3 if i < 1200 else 1 for i in range(2400)}
    names = [w for w, n in often.items() for _ in range(n)]
    df = spark.createDataFrame([(i, f"red green {w} blue black") for i, w in enumerate(names)], "doc_id long, text string")
    got = {r.doc_id: r.log_prob for r in scoring.score_documents(df).collect()}
    by_word = {w: got[i] for i, w in enumerate(names)}
    classes = scoring.word_classes(2404)
    other = classes**scoring.DEPTH // scoring.OTHER
    h = dict(zip(often, hashes(often).tolist(), strict=True))
    head = set(sorted(often, key=lambda w: (-often[w], h[w]))[: classes**scoring.DEPTH - other - 4])  # after the 4 words of all texts
    buckets = defaultdict(list)
    for w in often:
        if w not in head:
            buckets[h[w] % other].append(w)
    mixed = 0
    for words in buckets.values():
        for w in words:
            assert abs(by_word[w] - by_word[words[0]] - math.log(often[w] / often[words[0]])) < 1e-3
            mixed += often[w] != often[words[0]]
    assert mixed > 50
    assert scoring.word_classes(10**8) > scoring.word_classes(10**6) > scoring.word_classes(10**4)


def test_shares_sum_to_one(spark):
    texts = [" ".join(f"x{(i * 37 + j * j) % 3000}" for j in range(400)) for i in range(200)]
    runs = scoring.cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    counts = scoring.count_words(runs).cache()
    known = scoring.vocabulary(counts)
    rows = np.array([(r.hash, r.n) for r in counts.where("first").collect()])
    words = [w for t in texts for w in t.split()]
    assert len(rows) == len(set(words)) and rows[:, 1].sum() == len(words)
    unit, share = known.settle(rows[:, 0], rows[:, 1])
    total = np.bincount(unit, weights=np.exp(share))
    assert np.allclose(total[total > 0], 1) and unit.max() < known.classes**scoring.DEPTH
