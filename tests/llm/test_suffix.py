import hashlib
import random
from collections import Counter

import numpy as np

from logloom.llm import suffix


def brute(rows, span):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + span] for _, b in raw for i in range(len(b) - span + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = True
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def run(spark, rows, **k):
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, sha string")
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df, **k).collect())


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    para = [" ".join(word() for _ in range(rng.randrange(20, 160))) for _ in range(12)]
    rows = []
    for d in range(60):
        t = " ".join(rng.choice(para) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randrange(5, 80))) for _ in range(rng.randrange(1, 7)))
        if rng.random() < 0.3:
            k = rng.randrange(len(t))
            t = t[:k] + "X" + t[k + 1 :]
        rows.append((d, t))
    rows += [(100, None), (101, ""), (102, "short"), (103, "ab" * 400), (104, rows[3][1]), (105, rows[3][1]), (106, "q" * 199), (107, "r" * 200), (108, "r" * 201)]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    want = brute(rows, 200)
    assert run(spark, rows, span=200, texts=False) == want
    # all grams, or those with more than three contexts, go through the blocks of offsets
    assert run(spark, rows, span=200, hot=0) == want
    assert run(spark, rows, span=200, hot=3, texts=False) == want


def test_small_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 80").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert run(spark, rows, span=200, texts=False) == brute(rows, 200)


def test_edges(spark):
    assert run(spark, [], texts=False) == []
    got = run(spark, [(1, "k" * 300), (1, "k" * 300)], texts=False)
    assert [r[2] for r in got] == [300, 300]
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, c = text(300), text(250), text(400)
    rows = [(None, text(50) + a), (None, a + text(90)), (7, text(300) + b), (7, c + text(10)), (8, b), (9, text(20) + c + text(30)), (None, None), (7, text(700))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for texts in (False, True):
        got = suffix.remove_repeats(df, texts=texts).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got) == sorted((str(d), len(t or ""), n) for (d, t), n in zip(rows, (300, 300, 250, 400, 250, 400, 0, 0)))


def test_multikey_sort_orders_and_marks_ties():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    g = rng.integers(0, 4, 500).astype(np.uint64)
    order, same = suffix.multikey_sort(w, g)
    key = [(g[i], *w[i]) for i in range(500)]
    assert [key[i] for i in order] == sorted(key)
    n = Counter(key)
    assert [n[k] > 1 for k in key] == same.tolist()
