import hashlib
import math
from collections import Counter

from logloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy string, cdf string"


def u(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / 2**52


def count(rate, x):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= x:
        k += 1
        p *= rate / k
        c += p
    return k


def test_matches_inversion(spark, monkeypatch):
    rows = [(i, f"t{i}", "a" if i % 3 else "b", "q", "r") for i in range(900)] + [(900, None, None, None, None), (None, "x", "a", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    n = Counter(r[2] or "" for r in rows)
    want = Counter()
    weights = {"a": 1.0, "b": 5.0, "": 0.5}
    for r in rows:
        s = r[2] or ""
        k = count(weights[s] / 6.5 * 2000 / n[s], u(17, "null" if r[0] is None else r[0]))
        want[r[0]] += k
    plain = mixing.mix(df, weights=weights, total=2000).collect()
    assert Counter(r.doc_id for r in plain) == +want
    assert sorted(plain[0].asDict()) == ["cdf", "copy", "doc_id", "shuffle_key", "source", "text"] and plain[0]["cdf"] in ("r", None)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter(r.doc_id for r in mixing.mix(df, weights=weights, total=2000).collect()) == +want
    assert mixing.mix(df, weights={"b": 1.0}).where("source = 'a'").count() == 0
    assert mixing.mix(df.limit(0)).count() == 0


def test_shuffle_is_global_and_rates_hold(spark):
    df = spark.range(6000).selectExpr("id doc_id", "'t' text", "if(id < 2000, 'hot', 'cold') source")
    got = mixing.mix(df, weights={"hot": 3.0, "cold": 1.0}, total=8000).collect()
    c = Counter(r.source for r in got)
    assert abs(c["hot"] - 6000) < 400 and abs(c["cold"] - 2000) < 250
    ids = [r.doc_id for r in got]
    assert sum(a < b for a, b in zip(ids, ids[1:])) / len(ids) < 0.6
