import re
from collections import Counter

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def groups(rows, width=5):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in ids if find(d) == d}


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, seen = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before.collect(), docs.collect())
        assert docs.columns == cols + ["shard"] * (k == len(P.STAGES) - 1)
    ids = {n: ([r.doc_id for r in a], [r.doc_id for r in b]) for n, (a, b) in seen.items()}
    # language: prose stays, what has no letters goes
    lost = [r for r in seen["language_id"][0] if r.doc_id not in set(ids["language_id"][1])]
    assert len(lost) <= 0.1 * len(ids["language_id"][0])
    assert all(re.search(r"[^\W\d_]", r.text or "") for r in seen["language_id"][1])
    # one document of each group stays
    assert set(ids["near_dedup"][1]) == groups([(r.doc_id, r.text) for r in seen["near_dedup"][0]])
    # whole benchmark texts go, documents without twenty words of any in a row stay
    bench = [" ".join(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    runs = {" ".join(w[i : i + 8]) for w in (b.split(" ") for b in bench) for i in range(len(w) - 7)}
    kept = set(ids["decontamination"][1])
    for r in seen["decontamination"][0]:
        w = words(r.text)
        t = " ".join(w)
        if any(b in t for b in bench):
            assert r.doc_id not in kept
        if not any(" ".join(w[i : i + 8]) in runs for i in range(len(w) - 7)) and r.doc_id not in kept:
            raise AssertionError(f"clean document {r.doc_id} is gone")
    # mixing: rows are copies of rows, the total is near the input's
    a, b = ids["mixing"]
    assert set(b) <= set(a) and 0.7 * len(a) <= len(b) <= 1.3 * len(a)
    # shards: the same rows
    strip = lambda rows: Counter(tuple(r[c] for c in cols) for r in rows)
    assert strip(seen["sharding"][0]) == strip(seen["sharding"][1])


def test_odd_tables(spark):
    rows = [(1, None, None, None, None, 1), (None, "some words of text in a row here", "en", "a", 10, 1), (3, "", "en", "", 0, 1), (3, "", "en", "", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy int")
    for d in (docs, docs.limit(0)):
        for _, stage in P.STAGES:
            out = stage(spark, d, SF)
            assert out.columns[: len(d.columns)] == d.columns or out.count() == 0
            out.count()
