import math
import random

import numpy as np

from logloom.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, links string"


def brute(rows, least=0.98):
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    out = {r[0]: [0, r[0]] for r in rows}
    up = {r[0]: r[0] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    out[a[0]][0] += 1
                    out[b[0]][0] += 1
                    p, q = sorted((find(a[0]), find(b[0])))
                    up[q] = p
    return sorted((v, n, find(v), find(v) == v) for v, (n, _) in out.items())


def run(spark, rows, **k):
    df = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA)
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, **k).collect())


def test_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(30):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 9)):
            v = base + rng.standard_normal(16) * rng.choice([0, 0.05, 0.15, 0.25])
            rows.append((len(rows), [float(x) for x in v], int(c % 3) if c % 11 else None))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [None] * 16, 1), (903, [float("nan")] * 16, 1), (904, [1.0, 2.0], 1), (905, [2.0, 4.0], 1), (906, [], 1), (907, [float("inf")] * 16, 1)]
    random.Random(0).shuffle(rows)
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, block=20) == want
    assert run(spark, []) == []


def test_vectors_of_a_repeated_id_are_linked_each_by_itself(spark):
    x, y = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    near = lambda v: [a + 0.05 for a in v]
    rows = [(7, x, 1), (7, y, 1), (8, near(x), 1), (9, near(y), 1), (10, x, 1)]
    assert run(spark, rows) == [(7, 1, 7, True), (7, 2, 7, True), (8, 2, 7, False), (9, 1, 7, False), (10, 2, 7, False)]


def test_threshold_count():
    k = vectors.needed(24, 1.5, 1 - 1e-6)
    assert 8 <= k <= 14
    a = np.array([[0.0], [1.0]])
    assert vectors.collisions(a, a, 0.5).tolist() == [[1, 0], [0, 1]]


def test_vectors_of_a_repeated_id_and_extreme_components(spark):
    rows = [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [1.0, 0.001]), (9, [0.001, 1.0]), (20, [1e200, 1e200]), (21, [1e-200, 1e-200]), (22, [3e300, 3.01e300]), (23, [1e-300, -1e-300])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(df).collect())
    assert got == [(7, 1, 7), (7, 1, 7), (8, 1, 7), (9, 1, 7), (20, 2, 20), (21, 2, 20), (22, 2, 20), (23, 0, 23)]


def test_recall_at_the_threshold():
    """Of pairs with a cosine just above the threshold in 64 dimensions, as many collide often enough as planned."""
    rng = np.random.default_rng(2)
    n, d, least, reach = 4000, 64, 0.98, 1.5
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((n, d))
    y -= (x * y).sum(axis=1)[:, None] * x
    y = least * x + math.sqrt(1 - least**2) * y / np.linalg.norm(y, axis=1)[:, None]
    g = rng.standard_normal((d, 24))
    met = (np.abs(x @ g - y @ g) <= reach * math.sqrt(2 - 2 * least)).sum(axis=1)
    assert (met >= vectors.needed(24, reach, 1 - 1e-6)).mean() >= 0.999
