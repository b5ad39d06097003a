"""Operators that SQL can't express, against brute force and hand-made cases."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logloom.operators import anomaly, buffer, chunk, correlate, fleet, graph, respond, retrieve, sigma
from logloom.operators.canary import Canaries, collisions
from logloom.operators.privacy import Pseudonyms
from logloom.sources import advisories
from logloom.sources.schema import complete, parse_events, to_json

T0 = datetime(2026, 7, 30, 5, 30, tzinfo=timezone.utc)


def make(spark, rows):
    """Events of dicts; ``at`` is in seconds after T0."""
    data = [(i, T0 + timedelta(seconds=r.get("at", i)), *[r.get(k, "") for k in ("source_ip", "user", "outcome", "category", "process", "rule", "host", "severity", "message")], r.get("score", 10), r.get("fields", {}), f"{i:064x}") for i, r in enumerate(rows)]
    return complete(spark.createDataFrame(data, "seq bigint, timestamp timestamp, source_ip string, user string, outcome string, category string, process string, rule string, host string, severity string, message string, score int, fields map<string,string>, raw_sha256 string"))


def test_correlator_against_a_plain_loop(spark):
    rng = random.Random(5)
    rows, at = [], 0
    for _ in range(600):
        at += rng.choice([1, 1, 1, 2, 3, 30])
        rows.append({"at": at, "source_ip": rng.choice(["", "8.8.8.8", "10.0.0.1", "1.2.3.4"]), "user": rng.choice(["", "a", "b", "c", "d"]), "outcome": rng.choice(["failure"] * 6 + ["success", "blocked"]), "category": rng.choice(["authentication"] * 4 + ["privilege-escalation", "network"])})
    want, state = [], {}
    for i, r in enumerate(rows):
        fail = r["outcome"] == "failure" and r["category"] != "network"
        if not r["source_ip"] or not (fail or r["outcome"] == "success" and r["category"] == "authentication"):
            continue
        s = state.setdefault(r["source_ip"], {"f": [], "u": set(), "last": None})
        s["f"] = [t for t in s["f"] if t > r["at"] - 60]
        if fail:
            s["f"].append(r["at"])
            s["u"] |= {r["user"]} - {""}
            if len(s["f"]) >= 5 and (s["last"] is None or r["at"] - s["last"] >= 300):
                s["last"] = r["at"]
                want.append((i, "correlated_brute_force", 82 + (6 if r["source_ip"] != "10.0.0.1" else 0) + (4 if len(s["u"]) >= 3 else 0), len(s["f"])))
        elif len(s["f"]) >= 3:
            want.append((i, "correlated_successful_login_after_bruteforce", 97, len(s["f"])))
            s["f"] = []
    inc = correlate.incidents(make(spark, rows).repartition(7)).orderBy("seq").collect()
    got = [(r.seq, r.rule, r.score, int(r.fields.get("failure_count") or r.fields["preceding_failures"])) for r in inc]
    assert got == want and len({w[1] for w in want}) == 2


def test_duration():
    assert [correlate.duration(s) for s in (5, 60, 3600, 3725)] == ["5s", "1m0s", "1h0m0s", "1h2m5s"]


def test_events_survive_json(spark):
    e = make(spark, [{"source_ip": "1.2.3.4", "user": "ä\"\\", "fields": {"k": "v"}}, {}])
    back = parse_events(to_json(e))
    assert sorted(map(str, back.collect())) == sorted(map(str, e.collect()))
    odd = spark.createDataFrame([('{"seq": 3, "score": "54", "mitre": "x", "fields": [1], "new": 1}',), ("not json",), ("[1]",), ("",)], "value string")
    (r,) = parse_events(odd).collect()
    assert (r.seq, r.score, r.mitre, r.fields, r.category, r.severity) == (3, 54, [], {}, "uncategorised", "info")
    assert "user" not in json.loads(to_json(make(spark, [{}])).first().value)


RULE = """
title: Shell from the web
id: 1
logsource: {product: linux, service: sshd}
level: high
tags: [attack.execution, attack.t1059.004]
detection:
  sel_a: {Message|contains: [curl, wget], User: alice}
  sel_b: ["| sh", "| bash"]
  other: {CommandLine|re: '^/bin/'}
  condition: (1 of sel_* and not other) or (sel_a and sel_b)
"""


def test_imported_rules(spark):
    r = sigma.transpile(sigma.load_yaml(RULE), "a.yml")
    assert (r.name, r.score, r.category, r.processes, r.mitre) == ("sigma_shell_from_the_web", 72, "execution", ("sshd",), ("T1059.004",))
    assert r.tags == ("execution", "実行", "shell-execution", "シェル実行", "sigma", "シグマ", "execution")
    e = make(spark, [{"message": "CURL x", "user": "Alice"}, {"message": "x | bash"}, {"message": "/bin/x | sh"}, {"message": "/bin/curl | sh", "user": "alice"}, {"message": "curl", "user": "bob"}])
    assert [x.seq for x in e.where(r.condition(sigma.event_field)).orderBy("seq").collect()] == [0, 1, 3]
    rep = sigma.compile_all([("b.yml", RULE.replace("contains", "base64offset")), ("a.yml", RULE), ("c.yml", "title: x"), ("d.yml", RULE.replace("linux", "windows")), ("e.yml", RULE.replace("^/bin/", "(a+)+$"))])
    assert ([x.source for x in rep.rules], [n for n, _ in rep.skipped], [n for n, _ in rep.failed]) == (["a.yml"], ["b.yml", "d.yml"], ["c.yml", "e.yml"])
    assert sigma.load_bundle(json.dumps(rep.bundle())) == rep.rules
    with pytest.raises(sigma.RuleError):
        sigma.load_bundle(json.dumps(rep.bundle() | {"version": 2}))
    with pytest.raises(sigma.RuleError):
        sigma.load_bundle(json.dumps(rep.bundle() | {"extra": 1}))


@pytest.mark.parametrize("bad", [{"user": []}, {"users": ["a", "A"]}, {"users": [""]}, {"paths": ["abc"]}, {"users": [{"value": "x", "other": 1}]}])
def test_bad_canaries_are_refused(bad):
    with pytest.raises(ValueError):
        Canaries.of(bad)


def test_canary_collisions(spark):
    c = Canaries.of({"users": ["Decoy", "real"]})
    assert [r.value for r in collisions(c, spark.createDataFrame([("REAL ",), ("x",)], "name string")).collect()] == ["real"]


def test_chunks_cover_the_text_within_their_budget():
    rng = random.Random(1)
    for _ in range(40):
        t = "".join(rng.choice(["word ", "語", "。", "\n", "\n\n", ". ", "\n## h", "longerword"]) for _ in range(rng.randint(0, 400)))
        parts = chunk.split_text(t, 30)
        assert all(chunk.tokens(p) <= 30 for p in parts)
        squeeze = lambda s: "".join(s.split())
        assert squeeze("".join(parts)) == squeeze(t)
    laps = chunk.overlap(["one two three four", "five", "six"], 2)
    assert laps[0] == "one two three four" and laps[1].endswith("\nfive") and len(laps) == 3


def test_retrieval_keeps_a_floor_for_each_language(spark):
    texts = [(f"e{i}", f"ssh brute force attack number {i}", "en") for i in range(12)] + [("j0", "ssh 総当たり攻撃", "ja"), ("j1", "ssh 認証失敗", "ja")]
    docs = spark.createDataFrame([(i, i, t, "s", lg, "advisory", {}) for i, t, lg in texts], advisories.DOCUMENT)
    h = chunk.hierarchy(docs)
    parents = chunk.parents(h)
    chunks = retrieve.index(chunk.children(h), dim=256).cache()
    for k in (2, 3, 5):
        got = retrieve.retrieve("ssh brute force", chunks, parents, k, dim=256).collect()
        langs = [r.lang for r in got]
        assert len(got) == k and langs.count("ja") >= min(2, k // 2) and [r.score for r in got] == sorted([r.score for r in got], reverse=True)
    assert retrieve.index(chunk.children(h), chunks, 256).count() == 0
    lost = retrieve.retrieve("ssh", chunks, parents.where("doc_id <> 'j0'"), 5, dim=256).where("doc_id = 'j0'").first()
    assert lost is None or lost.reconstructed
    with pytest.raises(ValueError):
        retrieve.where({"a": {"$gt": 1}})


def test_where_treats_missing_keys_as_unequal(spark):
    df = spark.createDataFrame([("a", {"x": "1"}), ("b", {})], "chunk_id string, metadata map<string,string>")
    ids = lambda f: [r.chunk_id for r in df.where(retrieve.where(f)).orderBy("chunk_id").collect()]
    assert ids({"x": 1}) == ["a"] and ids({"x": {"$ne": 1}}) == ["b"] and ids({"x": {"$nin": [2]}}) == ["a", "b"] and ids({"$or": [{"x": 1}, {"x": {"$in": []}}]}) == ["a"] and ids({}) == ["a", "b"]


def test_blast_radius_respects_time(spark):
    rows = [{"at": 0, "process": "cron-job", "user": "root", "fields": {"command": "/opt/old/task"}}, {"at": 10, "source_ip": "9.9.9.9", "user": "ann", "outcome": "success"}, {"at": 20, "user": "ann", "fields": {"target_user": "root", "command": "/opt/new/tool"}},
            {"at": 30, "source_ip": "9.9.9.9", "user": "bob", "outcome": "failure"}]
    e = make(spark, rows)
    n, g = graph.nodes(e), graph.edges(e)
    got = {r.id: r.hops for r in graph.blast_radius(n, g, "source_ip:9.9.9.9").collect()}
    assert got == {"source_ip:9.9.9.9": 0, "user:ann": 1, "user:root": 2, "file:/opt/new/tool": 3}
    free = {r.id for r in graph.blast_radius(n, g, "source_ip:9.9.9.9", respect_time=False).collect()}
    assert "file:/opt/old/task" in free and "process:cron-job" in free and "user:bob" not in free
    assert graph.blast_radius(n, g, "user:none").count() == 0
    assert graph.shortest_path(g, "source_ip:9.9.9.9", "file:/opt/new/tool") == ["source_ip:9.9.9.9", "user:ann", "user:root", "file:/opt/new/tool"]
    (c,) = graph.chains(n, g).collect()
    assert (c.centre, len(c.members), c.score) == ("source_ip:9.9.9.9", 4, 87)
    assert graph.components(n, g).select("component").distinct().count() == 1
    assert graph.to_dot(n, g)[0].startswith("digraph")


def test_paths_of_a_command(spark):
    df = spark.createDataFrame([("cat /etc/shadow /bin/cat http://x/y /etc/shadow /a /srv/b.txt",)], "c string")
    assert df.select(graph.extract_paths(F.col("c"))).first()[0] == ["/etc/shadow", "/srv/b.txt"]


def test_anomalies_are_collapsed_and_cooled(spark):
    base = [{"at": -3600 * (30 + i), "category": "system", "process": "cron", "score": 5, "severity": "info"} for i in range(230)]
    new = [{"at": -3600 * 7 * i, "category": "deception", "process": "sshd", "rule": "odd_rule", "score": 90, "severity": "critical", "message": "strange"} for i in range(3)]
    now = T0
    found, facts = anomaly.report(make(spark, base + new), now)
    rows = found.collect()
    assert facts["baseline_events"] == 230 and not facts["low_confidence"]
    assert rows[0].kind == "novel" and rows[0].peak_score == 90 and len(rows) < 3
    state = anomaly.remember(spark.createDataFrame([], "key string, advised_at timestamp"), found, now)
    again, _ = anomaly.report(make(spark, base + new), now, state=state)
    assert again.count() == 0


def test_pseudonyms_round_trip():
    p = Pseudonyms(["web-1", "web-1-db"], ["ann", "root", "al"])
    t = "ann@x.org on web-1-db and web-1 from 10.0.0.1, 127.0.0.1, 8.8.8.8, aa:bb:cc:dd:ee:ff: ann al already root 10.0.0.1"
    s = p.scrub(t)
    assert s == "EMAIL_1 on HOST_1 and HOST_2 from IP_PRIVATE_1, IP_LOOPBACK_1, 8.8.8.8, MAC_1: USER_1 USER_2 already root IP_PRIVATE_1"
    assert p.restore(s) == t


def test_decisions(spark):
    rows = [("10.1.1.1", 95), ("x", 95), ("8.8.8.8", 50), ("224.0.0.9", 99), ("8.8.4.4", 95), ("9.9.9.9", 99), ("fd00::1", 99)]
    df = spark.createDataFrame([(i, a, s, "r") for i, (a, s) in enumerate(rows)], "seq bigint, source_ip string, score int, rule string")
    why = lambda **k: [r.reason for r in respond.decide(df, allowlist=["10.0.0.0/8", "fd00::/8", "bad"], **k).orderBy("seq").collect()]
    assert why() == [respond.ALLOWED, respond.INVALID, respond.LOW, respond.NO_HOST, "r", "r", respond.ALLOWED]
    assert why(mode="enforce", per_hour=20, recent=19)[4:6] == ["r", respond.RATE]
    assert set(why(mode="disabled")) == {respond.INVALID, respond.DISABLED}


def test_alert_inputs(spark):
    e = buffer.with_pos(make(spark, [{"source_ip": "1.1.1.1", "rule": "a", "category": "c", "score": 70, "message": "first"}, {"source_ip": "2.2.2.2", "rule": "a", "score": 70, "category": "c", "message": "second"}, {"source_ip": "1.1.1.1", "rule": "b", "category": "d"}]))
    i = buffer.indicators(e).first()
    assert (i.source_ips, i.rules, i.event_count, i.peak_score) == (["1.1.1.1", "2.2.2.2"], ["a", "b"], 3, 70)
    assert buffer.query_text(e, " why ").first().query == "why\ndetections: a, b\ncategories: c, d\nmost severe event: first"
    assert buffer.alert_id(e, "q").first()[0] == buffer.alert_id(e.repartition(3), "q").first()[0] != buffer.alert_id(e, "r").first()[0]
    assert buffer.signals(e).first().sources == 2


def test_advisories(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("---\nid: A-1\ntitle: 'SSH guide'\nkeywords:\n  - brute force\n  - 総当たり\nmitre: [T1110, T1078]\n---\n# H\nbody\n")
    (tmp_path / "b.md").write_text("# 日本語の見出し\nこれは本文です。")
    (tmp_path / "README.md").write_text("no")
    (tmp_path / "c.txt").write_text("no")
    found = advisories.read_advisories(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert len(found) == 2, found
    a, b = found
    assert (a.doc_id, a.title, a.lang) == ("A-1", "SSH guide", "en") and a.text.startswith("# SSH guide\nkeywords: brute force, 総当たり\nMITRE ATT&CK: T1110, T1078\n\n# H")
    assert (b.doc_id, b.title, b.lang) == ("advisory:b", "日本語の見出し", "ja")
    assert advisories.front_matter("x") == ({}, "x") and [advisories.scalar(x) for x in ("yes", "-3", "1.5", "'a'")] == [True, -3, 1.5, "a"]


def test_stream_carries_state_over_batches(spark, tmp_path):
    from logloom.plans.ingest import Options, to_events
    from logloom.streaming import correlate as S
    from logloom.streaming.sinks import discard, jsonl, tee
    from logloom.streaming.tail import TailSource

    log = tmp_path / "auth.log"
    line = "2026-07-30T05:30:{:02d}Z gw sshd[1]: {} password for {} from 203.0.113.9 port 1 ssh2\n"
    log.write_text("".join(line.format(i, "Failed", f"u{i}") for i in range(4)) + "\n2026-07-30T05:30:05Z gw sshd[1]: unfinish")
    spark.dataSource.register(TailSource)
    raw = spark.readStream.format("tail").option("path", str(log)).load()
    events = to_events(raw, Options(now=T0))
    out = tmp_path / "out"
    q = S.write_incidents(events, tee(jsonl(str(out)), discard()), str(tmp_path / "ck"))
    try:
        q.processAllAvailable()
        with log.open("a") as f:
            f.write("ed\n" + line.format(6, "Failed", "u9") + line.format(8, "Accepted", "u9"))
        q.processAllAvailable()
    finally:
        q.stop()
    rows = parse_events(spark.read.text(str(out / "*"))).orderBy("seq").collect()
    assert [(r.seq, r.rule, r.score) for r in rows] == [(5, "correlated_brute_force", 92), (6, "correlated_successful_login_after_bruteforce", 97)]
    with pytest.raises(RuntimeError):
        def broken(df, i):
            raise RuntimeError("no")
        tee(broken, discard())(spark.range(1), 0)


def test_alerts(spark):
    from logloom.operators import analyst as A

    e = make(spark, [{"source_ip": "203.0.113.5", "user": "ann", "host": "web-1", "rule": "r1", "category": "authentication", "score": 70, "severity": "high", "message": "ann at web-1"}, {"rule": "r2", "category": "execution", "score": 40, "severity": "warning"}])
    a = A.by_rules(e, question="q")
    assert (a["severity"], a["degraded"], a["title"]["en"]) == ("high", True, "HIGH: r1 on web-1 from 203.0.113.5") and "203.0.113.5" in a["recommended_actions"][0]
    sources = [{"text": "one"}, {"text": "two"}]

    def model(prompt):
        assert "web-1" not in prompt and "ann at" not in prompt
        return 'Sure: ```json {"severity": "critical", "confidence": 0.9, "title_en": "USER_1 on HOST_1", "citations": ["S2", "[S9]"], "mitre": ["T1"]} ```'

    b = A.by_model(e, model, sources)
    assert (b["severity"], b["title"]["en"], b["citations"], b["grounding"]["verdict"], b["confidence"]) == ("critical", "ann on web-1", [{"text": "two"}], A.PARTLY, 0.9)
    assert A.by_model(e, lambda p: '{"confidence": 0.9, "citations": ["S7"], "severity": "odd"}', sources)["confidence"] == 0.4
    assert A.by_model(e, lambda p: "no", sources)["degraded"]
    assert [A.grounding(*x) for x in ((0, 0), (2, 0), (2, 1), (2, 2))] == [A.UNGROUNDED, A.INVENTED, A.PARTLY, A.GROUNDED]
    assert A.clamp_severity("critical", "notice") == "warning" and A.extract_json('x {bad} {"a": "}"}') == {"a": "}"}


def test_prompt_budget(spark):
    from logloom.operators import analyst as A

    assert A.within("l" * 9, ["s"] * 3, 12) == ("l" * 9, ["s"] * 3)
    log, kept = A.within("l" * 5000, ["a" * 900, "b" * 900, "c" * 900], 1000)
    assert log == "l" * A.LOG_LEAST + " […3000 characters left out]" and kept == ["a" * 900, "b" * 100 + " […800 characters left out]", " […900 characters left out]"]
    assert A.within("l" * 5000, ["a" * 900], 4900)[0].startswith("l" * 4000 + " […1000 ")
    e = make(spark, [{"user": "ann", "host": "web-1", "message": "ann at web-1 " * 9, "rule": "r", "category": "c", "severity": "high"}])
    seen = []
    A.by_model(e, lambda p: seen.append(p) or "{}", [{"text": "web-1 " * 9000}], "is ann in?", most=3000)
    assert len(seen[0]) < 6000 and "ann" not in seen[0] and "web-1" not in seen[0]


def test_audit_is_appended_and_read_with_broken_lines(spark, tmp_path):
    df = spark.createDataFrame([(0, "8.8.8.8", 95, "r"), (1, "10.0.0.1", 20, "r")], "seq bigint, source_ip string, score int, rule string")
    path = str(tmp_path / "audit")
    for hour in (1, 2):
        respond.append(respond.decide(df, allowlist=["10.0.0.0/8"]), F.lit(T0 + timedelta(hours=hour)), path)
    (tmp_path / "audit" / "part-broken.json").write_text('not json\n[1]\n\n{"reason": "cut')
    audit = respond.read_audit(spark, path)
    assert audit.count() == 4
    assert [(r.allowed, r.reason) for r in respond.history(audit, 2).orderBy("score").collect()] == [(False, respond.ALLOWED), (True, "r")]
    assert respond.history(audit, 1).first().at > audit.agg(F.min("at")).first()[0]
    assert tuple(respond.status(audit, T0 + timedelta(hours=2, minutes=30)).first()) == (1, 4, 2)


def test_revocations_are_read_anew(spark, tmp_path):
    file = tmp_path / "revoked.json"
    rows = spark.createDataFrame([("a", "AB:CD"), ("b", "ef 01"), ("c", None), (None, "ffff")], "probe string, fingerprint string")
    deny = fleet.Revocations(str(file))
    denied = lambda: sorted(str(r.probe) for r in rows.where(deny.denies()).collect())
    assert denied() == []
    file.write_text(json.dumps({"revoked": [{"fingerprint": "abcd"}, {"name": "c"}, {"fingerprint": "EF:01", "name": "x"}, 7]}))
    assert denied() == ["a", "b", "c"]
    file.write_text("{broken")
    assert denied() == ["a", "b", "c"]
    file.write_text(json.dumps({"revoked": [{"name": "b"}]}))
    assert denied() == ["b"]
    file.unlink()
    assert denied() == []


def test_bundles_of_a_folder_in_the_order_of_names(tmp_path):
    one = sigma.compile_all([("a.yml", RULE)]).bundle()
    for name, title in (("b.json", "second"), ("a.json", "first"), ("c.txt", "none")):
        (tmp_path / name).write_text(json.dumps(one | {"rules": [r | {"name": title} for r in one["rules"]]}))
    assert [r.name for r in sigma.load_folder(str(tmp_path))] == ["first", "second"]
    assert sigma.load_folder(str(tmp_path / "missing")) == []
    (tmp_path / "d.json").write_text("{}")
    with pytest.raises(sigma.RuleError):
        sigma.load_folder(str(tmp_path))


def test_routes_have_no_bound_of_hops(spark):
    hops = 66
    edge = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}", True) for k in range(hops)], "src string, dst string, grants_access boolean")
    assert graph.shortest_path(edge, "n000", f"n{hops:03}") == [f"n{k:03}" for k in range(hops + 1)]
