"""Work that must grow with the input only: events are read once or twice, states and matrices stay small."""

import random
import time
import tracemalloc
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from logloom.operators import anomaly, chunk, correlate, graph, respond, retrieve
from logloom.plans.ingest import Options, to_events

NOW = datetime(2024, 1, 30, tzinfo=timezone.utc)


def counted(df):
    """The rows, and a counter of how often a row was made."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(len(b))
            yield b

    return df.mapInPandas(run, df.schema), made


def ssh(spark, n=200, users=7):
    rows = [(i, f"2024-01-{1 + i * 29 // n:02d}T{i % 24:02d}:00:{i % 60:02d}Z host sshd[9]: {'Failed' if i % 3 else 'Accepted'} password for user{i % users} from 203.0.113.{i % 4} port 22 ssh2") for i in range(n)]
    return to_events(spark.createDataFrame(rows, "seq long, raw string"), Options(now=NOW))


def test_only_the_wanted_columns_are_computed(spark):
    lines = spark.createDataFrame([(1, "2024-01-01T00:00:00Z h sshd[1]: Failed password for root from 203.0.113.9 port 5 ssh2")], "seq long, raw string")
    few = to_events(lines, Options(now=NOW, columns=("seq", "severity", "score")))
    full = to_events(lines, Options(now=NOW)).select("seq", "severity", "score")
    assert few.columns == ["seq", "severity", "score"] and few.collect() == full.collect()
    assert "sha2" not in few._jdf.queryExecution().optimizedPlan().toString().lower()
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_times_and_tags_of_odd_lines(spark):
    from logloom.operators.parse import iso_time, parse

    odd = ["2024-02-30T00:00:00Z", "2024-02-29T23:59:59.1234567Z", "2024-02-29T23:59:60Z", "2024-02-29T24:00:00Z", "2023-02-29T00:00:00.5Z", "2024-01-01 00:00:00Z", "2024-01-01T00:00:00+09:00", "0999-01-01T00:00:00Z"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, t string").select("i", F.unix_micros(iso_time(F.col("t"))).alias("us"))
    us = lambda *a: int((datetime(*a, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))
    assert [r.us for r in t.orderBy("i").collect()] == [None, us(2024, 2, 29, 23, 59, 59, 123456), None, None, None, None, us(2023, 12, 31, 15), us(999, 1, 1)]
    tags = ["app[7]:  two", "app[]: x", "a/b.c-d:", "app[7] x", "app: a\nb"]
    p = parse(spark.createDataFrame([(i, x) for i, x in enumerate(tags)], "i int, clean string"), now=NOW).orderBy("i").collect()
    assert [(r.env_process, r.env_pid, r.env_message) for r in p] == [("app", 7, " two"), ("", 0, "app[]: x"), ("a/b.c-d", 0, ""), ("", 0, "app[7] x"), ("", 0, "app: a\nb")]


def test_anomalies_read_the_events_once(spark):
    e = ssh(spark).cache()
    seen, made = counted(e)
    found = anomaly.surprises(anomaly.tally(seen, NOW), min_bits=1.0)
    got = sorted(map(str, found.drop("bh").collect()))
    assert made.value == e.count() and got
    base, win = anomaly.split(e, NOW)
    assert sorted(map(str, anomaly.anomalies(base, win, min_bits=1.0).select(*found.drop("bh").columns).collect())) == got


def test_reports_read_the_events_twice(spark):
    e = ssh(spark).cache()
    seen, made = counted(e)
    out, facts = anomaly.report(seen, NOW, min_bits=1.0)
    assert out.collect() and made.value <= 2 * e.count() and facts["baseline_events"] == e.count() - anomaly.split(e, NOW)[1].count()


def test_rounds_over_a_graph_read_its_edges_once(spark):
    n = 6
    edge = spark.createDataFrame([(f"user:{i}", f"user:{i + 1}", "escalated_to", True, NOW, NOW) for i in range(n)] + [("source_ip:a", "user:0", "auth_success", True, NOW, NOW), (f"user:{n}", "file:/x", "accessed", True, NOW, NOW)], "src string, dst string, kind string, grants_access boolean, first_seen timestamp, last_seen timestamp")
    node = spark.createDataFrame([("source_ip:a", "source_ip", 50, NOW), ("file:/x", "file", 90, NOW), *[(f"user:{i}", "user", 40, NOW) for i in range(n + 1)]], "id string, kind string, peak_score int, first_seen timestamp")
    for run in (lambda a, b: graph.blast_radius(a, b, "source_ip:a", 9), graph.chains, graph.components):
        a, nodes = counted(node)
        b, edges = counted(edge)
        assert run(a, b).count() > 0
        assert nodes.value == node.count() and edges.value == edge.count()


def test_incidents_read_the_events_once(spark):
    e = ssh(spark).cache()
    cfg = correlate.Config(threshold=3, window_s=86400 * 9, cooldown_s=3600)
    seen, made = counted(e)
    got = correlate.incidents(seen, cfg)
    assert got.count() > 0 and made.value == e.count()
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in correlate.triggers(e, cfg).collect())


def test_a_long_window_is_not_walked_for_every_event():
    rng, cfg = random.Random(1), correlate.Config(threshold=10**9, window_s=3600, cooldown_s=60)
    # times that jump back, against the definition
    s, kept = correlate.State(), []
    for _ in range(500):
        at = rng.randrange(9000) * 1_000_000
        kept = [t for t in kept if t > at - 3_600_000_000] + [at]
        correlate.step(s, at, True, f"u{rng.randrange(40)}", cfg)
        assert sorted(s.failures) == sorted(kept)
    names = sorted(s.users)
    assert s.listed() == ", ".join(names[:10] + [f"+{len(names) - 10} more"])
    s, began = correlate.State(), time.process_time()
    for i in range(30_000):
        correlate.step(s, i, True, f"user{i}", cfg)
    assert len(s.failures) == 30_000 and time.process_time() - began < 3


def test_sliding_failures_are_a_running_sum(spark):
    rng = random.Random(2)
    at = [None if i % 50 == 0 else datetime(2024, 1, 1) + timedelta(seconds=10 * rng.randrange(60)) for i in range(400)]
    rows = [(i, i % 3 or None, t, rng.random() < 0.4) for i, t in enumerate(at)]
    d = spark.createDataFrame(rows, "i int, k int, t timestamp, f boolean")
    out = correlate.sliding_failures(d, "k", "t", 60, F.col("f"))
    assert out.columns == ["i", "k", "t", "f", "n_failures"] and out.count() == len(rows)
    inside = lambda a, b: (a is None and b is None) or (a is not None and b is not None and timedelta(0) <= b - a < timedelta(seconds=60))
    want = {i: sum(f2 and k2 == k and inside(t2, t) for _, k2, t2, f2 in rows) for i, k, t, _ in rows}
    assert {r.i: r.n_failures for r in out.collect()} == want
    assert "PRECEDING" not in out._jdf.queryExecution().optimizedPlan().toString().upper().replace("UNBOUNDEDPRECEDING", "")
    assert "-59999999" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_ranking_of_blocks_reads_the_candidates_once(spark):
    c = spark.createDataFrame([(i, f"203.0.113.{i % 9 + 1}", 95, "r") for i in range(50)], "seq long, source_ip string, score int, rule string")
    seen, made = counted(c)
    d = respond.decide(seen, mode="enforce", recent=12)
    assert d.where("allowed").count() == 8 and made.value == 50


def test_a_search_keeps_small_matrices_and_exact_ties():
    rng = np.random.default_rng(3)
    q = [SimpleNamespace(q=i, v=v) for i, v in enumerate(rng.integers(-2, 3, (700, 8)).astype(float))]
    x = rng.integers(-2, 3, (20_000, 8)).astype(float)
    want = []
    for r in q[:5]:
        scale = np.sqrt((r.v @ r.v) * (x * x).sum(axis=1))
        s = np.divide(x @ r.v, scale, out=np.zeros(len(x)), where=scale > 0)
        want += [(r.q, int(c), round(float(s[c]), 9)) for c in np.lexsort((np.arange(len(x)), -np.round(s, 12)))[:6]]
    shared = SimpleNamespace(value=retrieve._by_size(q))
    batch = pd.DataFrame({"c": np.arange(len(x)), "v": list(x)})
    tracemalloc.start()
    got = pd.concat(retrieve._best(shared, 6)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 120
    few = got[got.query_id < 5].sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True])
    assert len(got) == 700 * 6 and [round(s, 9) for s in few.score] == [s for _, _, s in want]


def test_wide_characters_are_found_by_place():
    text = "Plain words. 日本語のログ。 More words ６７ end"
    r = chunk._Ruler(text)
    assert chunk._Ruler("plain " * 9).places == []
    for a in range(len(text)):
        for b in range(a, len(text) + 1):
            assert r.count([(a, b)]) == chunk.tokens(text[a:b])
