"""The stages of the corpus pipeline on small written tables, and the votes of fingerprints, against brute force."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from quadrille.llm import fingerprints, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def passage(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or "")) for i, t in rows], SCHEMA)


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_near_copies_of_rows_that_share_an_id(spark):
    a, b = passage(1, 100), passage(2, 100)
    rows = [(1, a), (2, a + " end"), (2, b), (3, b), (3, b), (2, b), (4, None), (4, None), (5, ""), (None, a)]
    got = texts(P.drop_near_copies(spark, table(spark, rows), ""))
    assert got == Counter([(1, a), (2, b), (4, None), (4, None), (5, "")])
    assert P.drop_near_copies(spark, table(spark, rows).limit(0), "").count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(1, "common line here\nmine alone here"), (5, "common line here\nfive"), (5, "kept other text\nzzz"), (7, "kept other text"), (8, None), (None, "x")]
    got = P.drop_repeated_lines(spark, table(spark, rows), "")
    assert got.columns == P.COLUMNS and texts(got) == Counter([(1, rows[0][1]), (5, "five"), (5, rows[2][1]), (7, ""), (8, "")])
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_mix_takes_rows_as_often_as_the_operator_says(spark):
    rows = [(i % 40, passage(i % 60, 5 + i % 50)) for i in range(120)] + [(7, None), (None, "x")]
    docs = table(spark, rows)
    want = Counter()
    for r in mixing.mix(P.keyed(docs), keep=["row_hash"]).collect():
        want[r.doc_id, r.row_hash] += r.copies
    got = Counter((r.doc_id, r.row_hash) for r in P.keyed(P.mix_sources(spark, docs, "")).collect())
    assert got == +want and sum(got.values()) > 100


def test_run(spark, tmp_path):
    """Toxic texts go, their ids' clean rows stay; near copies are packed once; every piece is in one place."""
    bad = lambda i: passage(i, 80) + " idiot moron scum idiot " + passage(i + 1, 20)
    rows = [(100 + i, bad(i) if i % 4 == 0 else passage(1000 + i, 100)) for i in range(400)]
    rows += [(104, passage(5000, 90)), (900, passage(1001, 100) + " tail"), (901, ""), (902, None)]
    labels = [(100 + i, 1, int(i % 4 == 0)) for i in range(400)]
    docs = table(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = texts(P.drop_toxic(spark, docs, str(tmp_path)))
    toxic = [(i, t) for i, t in rows if "idiot" in (t or "")]
    assert sum(left[x] for x in toxic) <= 4 and left[104, passage(5000, 90)] == 1 and left[902, None] == 1
    assert sum(left.values()) >= len(rows) - len(toxic) - 4
    out = P.run(spark, str(tmp_path)).collect()
    by = Counter()
    for r in out:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 2048 and 900 not in {r.doc_id for r in out} and len({(r.sequence_id, r.offset) for r in out}) == len(out)
    assert [name for name, _ in P.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "source_mix", "packing"]


def test_votes_by_hand(spark):
    rows = [(1, "The cat  sat on the mat"), (2, "one\tOne oNe two"), (3, None), (4, passage(3, 500)), (5, "ünïcode Ünïcode extraordinarily")]
    words = {i: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w] for i, t in rows}
    each = spark.createDataFrame([(w,) for w in sorted({w for x in words.values() for w in x})], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    h = {r.w: r.h & (2**64 - 1) for r in each}
    want = {}
    for i, x in words.items():
        total, up = sum(min(len(w), 12) for w in x), [0] * 64
        for w in x:
            for k in range(64):
                up[k] += min(len(w), 12) * (h[w] >> k & 1)
        want[i] = sum(1 << k for k in range(64) if 2 * up[k] > total)
    got = {r.doc_id: int(r.fingerprint, 16) for r in fingerprints.fingerprint_edits(table(spark, rows)).collect()}
    assert got == want
