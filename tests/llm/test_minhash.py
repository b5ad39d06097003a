import random
import re

from logloom.llm import minhash
from logloom.llm.components import components
from logloom.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, n string, key string"


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, percent=80):
    sets = {d: shingle_set(t, width) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                r, q = sorted((find(a), find(b)))
                up[q] = r
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def run(spark, rows, width):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, width=width).collect()}


def test_matches_brute_force_on_variants(spark):
    rng = random.Random(3)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 20, 60, 150]))]
        for _ in range(9):
            v = list(words)
            for _ in range(rng.randrange(0, 1 + len(v) // 8)):
                v[rng.randrange(len(v))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(v)))
    for width in (2, 5):
        assert run(spark, rows, width) == brute(rows, width)


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, width=2).collect()} == brute(rows, 2)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \t\n"), (4, "One"), (5, "oNE\x0b"), (6, "café É"), (7, "café é"), (8, "a b " * 50000), (9, "A b " * 50000)]
    got = run(spark, rows, 2)
    assert got == brute(rows, 2)
    assert got[1] == (0, 1, True) and got[5] == (1, 4, False) and got[9][1] == 8
    assert run(spark, [], 2) == {}
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted(((r.doc_id or -1), r.component_id, r.kept) for r in minhash.near_duplicates(df, width=2).collect()) == [(-1, 1, True), (1, 1, True), (1, 1, True)]


def test_texts_of_a_repeated_id_are_linked_each_by_itself(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(7, a), (7, b), (8, a + " more"), (9, b + " more"), (10, a + " else"), (11, b + " else"), (12, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df, width=2).collect())
    assert got == [(7, 7, True), (7, 7, True), *[(k, 7, False) for k in (8, 9, 10, 11)], (12, 12, True)]


def test_a_family_around_the_threshold(spark):
    """Edits shared by few, outliers of all kinds and a group larger than what meets unfiltered."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(150)]
    rows = []
    for _ in range(140):
        v = list(words)
        for _ in range(rng.randrange(0, 22)):
            v[rng.randrange(len(v))] = f"x{rng.randrange(40)}"
        if rng.random() < 0.2:
            v = v[: rng.randrange(110, 150)]
        rows.append((len(rows), " ".join(v)))
    for width in (2, 5):
        want = brute(rows, width)
        assert run(spark, rows, width) == want
        assert len({c for _, c, _ in want.values()}) > 20


def test_recall_of_the_tables_at_the_threshold():
    """Share of pairs at a similarity of 0.8 to 0.81 that meet in a table."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = []
    for _ in range(4000):
        w = rng.integers(0, 1 << 40, 199).astype(str)
        x, y = list(w[:180]), list(w[:180])
        y[:20] = w[180:]  # 160 of 200 five-word windows and a few less
        texts += [" ".join(x), " ".join(y)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000)), pa.array(texts), pa.array(range(8000))], names=["i", "t", "h"])
    a, b = [], []
    for out in minhash.signatures(1, 14, 4)([batch]):
        a += out.column("a").to_pylist()
        b += out.column("b").to_pylist()
    met = sum(1 for k in range(0, 8000, 2) if set(a[k]) & set(a[k + 1]) and set(b[k]) & set(b[k + 1]))
    assert met >= 0.998 * 4000


def test_components_long_path(spark):
    n = 60
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    e = spark.createDataFrame(list(zip(ids, ids[1:])) + [(100, 101), (101, 102)], "a long, b long")
    got = {r.node: r.component for r in components(e, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100, 102: 100}
