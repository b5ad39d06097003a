"""The SQL twins of ``plans.queries``, for DuckDB over the same tables.

They read the synthetic lines with RE2, in which the rules are written, and know nothing of
the engine's rewriting, so they are independent of it.
"""

from __future__ import annotations

from logloom.operators.rules import RULES
from logloom.plans.queries import ENVELOPE, LINE, SAMPLES

# message is all that follows "time host process[pid]: "
EVENTS = rf"""
WITH l AS (SELECT event_id AS seq, ts, {LINE.replace("stamp", "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')")} AS raw FROM events),
p AS (SELECT seq, ts, raw, regexp_extract(raw, '^\S+ (\S+) ', 1) AS host, regexp_extract(raw, '^\S+ \S+ ([A-Za-z0-9_./-]+)(?:\[\d+\])?: ', 1) AS process,
  regexp_extract(raw, '^\S+ \S+ [A-Za-z0-9_./-]+\[(\d+)\]: ', 1) AS pid, regexp_extract(raw, '^\S+ \S+ [A-Za-z0-9_./-]+(?:\[\d+\])?: ?(.*)$', 1) AS message FROM l),
r AS (SELECT *, CASE
  WHEN process = 'sshd' AND regexp_matches(message, 'Failed (?:password|keyboard-interactive/pam|publickey) for (?:invalid user )?[^\s]+ from [0-9a-fA-F.:]+ port \d+') THEN 'ssh_failed_password'
  WHEN process = 'sshd' AND regexp_matches(message, 'Accepted (password|publickey) for [^\s]+ from [0-9a-fA-F.:]+ port \d+') THEN 'ssh_accepted_login'
  WHEN process = 'sudo' AND regexp_matches(message, '\S+ : TTY=\S+ ; PWD=\S+ ; USER=\S+ ; COMMAND=.+$') THEN 'sudo_command_executed'
  WHEN regexp_matches(message, 'new user: name=[^,]+, UID=\d+') THEN 'new_user_created'
  WHEN regexp_matches(message, '\[UFW (?:BLOCK|AUDIT)\].*?SRC=[0-9a-fA-F.:]+ DST=[0-9a-fA-F.:]+.*?PROTO=\S+') THEN 'ufw_block' ELSE '' END AS rule FROM p),
e AS (SELECT *,
  CASE rule WHEN 'ssh_failed_password' THEN 'authentication' WHEN 'ssh_accepted_login' THEN 'authentication' WHEN 'sudo_command_executed' THEN 'privilege-escalation' WHEN 'new_user_created' THEN 'persistence' WHEN 'ufw_block' THEN 'network' ELSE 'uncategorised' END AS category,
  CASE rule WHEN 'ssh_failed_password' THEN 46 + 8 WHEN 'ssh_accepted_login' THEN 26 + 8 WHEN 'sudo_command_executed' THEN 32 + 10 WHEN 'new_user_created' THEN 68 WHEN 'ufw_block' THEN 30 + 8 ELSE 5 END::BIGINT AS score,
  CASE rule WHEN 'ssh_failed_password' THEN 'failure' WHEN 'ufw_block' THEN 'blocked' WHEN '' THEN '' ELSE 'success' END AS outcome,
  CASE rule WHEN 'ssh_failed_password' THEN 7 WHEN 'ssh_accepted_login' THEN 7 WHEN 'sudo_command_executed' THEN 5 WHEN 'new_user_created' THEN 4 WHEN 'ufw_block' THEN 6 ELSE 1 END::BIGINT AS n_tags,
  CASE WHEN rule LIKE 'ssh%' THEN regexp_extract(message, ' from ([0-9.]+) port ', 1) WHEN rule = 'ufw_block' THEN regexp_extract(message, 'SRC=([0-9.]+)', 1) ELSE '' END AS source_ip,
  CASE WHEN rule = 'ufw_block' THEN regexp_extract(message, 'DST=([0-9.]+)', 1) ELSE '' END AS dest_ip,
  coalesce(try_cast(CASE WHEN rule LIKE 'ssh%' THEN regexp_extract(message, ' port (\d+)', 1) WHEN rule = 'ufw_block' THEN regexp_extract(message, 'SPT=(\d+)', 1) END AS BIGINT), 0) AS source_port,
  coalesce(try_cast(CASE WHEN rule = 'ufw_block' THEN regexp_extract(message, 'DPT=(\d+)', 1) END AS BIGINT), 0) AS dest_port,
  CASE rule WHEN 'sudo_command_executed' THEN regexp_extract(message, '(\S+) : TTY', 1) WHEN 'new_user_created' THEN regexp_extract(message, 'name=([^,]+)', 1) WHEN 'ufw_block' THEN '' ELSE regexp_extract(message, 'password for (\S+)', 1) END AS "user",
  CASE WHEN rule = 'sudo_command_executed' THEN 'root' ELSE '' END AS target_user, CASE WHEN rule = 'sudo_command_executed' THEN regexp_extract(message, 'COMMAND=(.+)$', 1) ELSE '' END AS command FROM r),
v AS (SELECT *, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'warning' WHEN score >= 20 THEN 'notice' ELSE 'info' END AS severity,
  CASE WHEN score >= 80 THEN 4 WHEN score >= 60 THEN 3 WHEN score >= 40 THEN 2 WHEN score >= 20 THEN 1 ELSE 0 END AS rank FROM e)"""

NODES = r"""
, n0 AS (
  SELECT 'source_ip' AS kind, source_ip AS label, * FROM v WHERE source_ip <> '' UNION ALL SELECT 'host', host, * FROM v WHERE host <> '' UNION ALL SELECT 'user', "user", * FROM v WHERE "user" <> ''
  UNION ALL SELECT 'user', target_user, * FROM v WHERE target_user <> '' UNION ALL SELECT 'user', 'root', * FROM v WHERE rule = 'new_user_created' UNION ALL SELECT 'process', process, * FROM v WHERE "user" <> '' AND process NOT IN ('sshd', 'sudo', 'CRON', 'systemd')
  UNION ALL SELECT 'file', unnest(string_split(command, ' ')), * FROM v WHERE command <> '')"""
EDGES = r"""
, e0 AS (
  SELECT 'source_ip:' || source_ip AS src, 'user:' || "user" AS dst, 'auth_' || outcome AS kind, * FROM v WHERE source_ip <> '' AND "user" <> '' AND outcome IN ('success', 'failure')
  UNION ALL SELECT 'source_ip:' || source_ip, 'host:' || host, 'connected_to', * FROM v WHERE source_ip <> '' AND "user" = '' AND host <> ''
  UNION ALL SELECT 'user:' || "user", 'user:' || target_user, 'escalated_to', * FROM v WHERE "user" <> '' AND target_user <> '' AND "user" <> target_user
  UNION ALL SELECT 'user:' || "user", 'process:' || process, 'executed', * FROM v WHERE "user" <> '' AND target_user = '' AND process NOT IN ('sshd', 'sudo', 'CRON', 'systemd')
  UNION ALL SELECT 'user:' || target_user, 'file:' || unnest(string_split(command, ' ')), 'accessed', * FROM v WHERE command <> ''
  UNION ALL SELECT 'user:root', 'user:' || "user", 'created', * FROM v WHERE rule = 'new_user_created'),
g AS (SELECT src, dst, kind, count(*) AS n, max(score) AS peak_score, kind IN ('auth_success', 'escalated_to', 'executed', 'accessed', 'created') AS grants_access, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM e0 GROUP BY ALL)"""
DIMS = """
, d0 AS (SELECT *, ts >= TIMESTAMP '2024-01-29 23:59:59' AS recent FROM v),
u AS (SELECT 'rule' AS dim, rule AS value, * FROM d0 WHERE rule <> '' UNION ALL SELECT 'category', category, * FROM d0 UNION ALL SELECT 'process', process, * FROM d0 WHERE process <> '' UNION ALL SELECT 'user', "user", * FROM d0 WHERE "user" <> ''
  UNION ALL SELECT 'source_ip', source_ip, * FROM d0 WHERE source_ip <> '' UNION ALL SELECT 'hour', strftime(ts, '%H'), * FROM d0),
b AS (SELECT dim, value, count(*) AS n FROM u WHERE NOT recent GROUP BY ALL), t AS (SELECT dim, sum(n) AS total, count(*) AS vocab FROM b GROUP BY ALL),
w AS (SELECT dim, value, count(*) AS n, max(score) AS peak_score FROM u WHERE recent GROUP BY ALL),
h AS (SELECT (epoch_us(max(ts) FILTER (NOT recent)) - epoch_us(min(ts) FILTER (NOT recent))) / 3.6e9 AS bh, (epoch_us(max(ts) FILTER (recent)) - epoch_us(min(ts) FILTER (recent))) / 3.6e9 AS wh FROM d0),
a AS (SELECT w.dim, w.value, w.n, coalesce(b.n, 0) AS baseline_count, w.peak_score, -log2((coalesce(b.n, 0) + 0.5) / (coalesce(t.total, 0) + 0.5 * (coalesce(t.vocab, 0) + 1))) AS rarity,
  CASE WHEN b.n > 0 AND wh > 0 AND bh > 0 THEN greatest(0.0, log2(w.n / (b.n / bh * wh))) ELSE 0.0 END AS spike FROM w LEFT JOIN b ON w.dim = b.dim AND w.value = b.value LEFT JOIN t ON w.dim = t.dim, h)"""
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KANA = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}"
CJK = KANA + r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
VECTORS = "SELECT a.vec_id AS query_id, b.vec_id, b.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0"
DECIDED = """, c AS (SELECT seq, rule, source_ip, score, CASE WHEN source_ip = '' THEN 'invalid IP address' WHEN source_ip IN ('203.0.113.0', '203.0.113.1', '203.0.113.2', '203.0.113.3') AND {allow} THEN 'target is allowlisted' WHEN score < 38 THEN 'score below threshold' END AS why FROM v)"""

_q = lambda s: "'" + s.replace("'", "''") + "'"
# the patterns as they are written, by RE2
VERDICT = "CASE " + " ".join(f"WHEN {'p IN (' + ', '.join(map(_q, r.process)) + ') AND ' if r.process else ''}regexp_matches(m, {_q(r.pattern)}) THEN {_q(r.name)}" for r in RULES) + " ELSE '' END"
OF_RULE = lambda c, other: "CASE rule " + " ".join(f"WHEN {_q(r.name)} THEN {_q(getattr(r, c))}" for r in RULES) + f" ELSE {_q(other)} END"

ORACLE = {
    "byte_lines": EVENTS + r""", h AS (SELECT seq, strlen(raw) AS n, regexp_replace(hex(encode(raw)) || CASE seq % 5 WHEN 0 THEN 'FFFE' WHEN 1 THEN '0D' WHEN 2 THEN 'C30D0D' WHEN 3 THEN 'E38182' ELSE '' END, '(0D)+$', '') AS x FROM l)
        SELECT seq, CASE seq % 5 WHEN 0 THEN n < 90 WHEN 2 THEN n < 90 WHEN 3 THEN n IN (88, 89) ELSE false END AS san_invalid_utf8, sha256(unhex(left(x, 180))) AS raw_sha256, length(left(x, 180)) // 2 AS n_bytes FROM h""",
    "capped": """WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, CASE WHEN strlen(t) <= 60 THEN t ELSE left(t, list_max(list_filter(range(0, 47), lambda k: strlen(left(t, k)) <= 46))) || '…[truncated]' END AS capped FROM t""",
    "envelopes": f"""WITH e AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, '' AS bsd, event_id % 5 AS k FROM events)
        SELECT event_id AS seq, CASE k WHEN 0 THEN 'rfc5424' WHEN 1 THEN 'rfc3164' ELSE 'raw' END AS format, CASE k WHEN 0 THEN 'auth' WHEN 1 THEN 'user' ELSE '' END AS facility, CASE k WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE -1 END::BIGINT AS level,
        CASE WHEN k < 2 THEN 'host' || user_id % 5 ELSE '' END AS host, CASE k WHEN 0 THEN 'app' WHEN 1 THEN 'cron' WHEN 3 THEN 'app' ELSE '' END AS process, CASE k WHEN 0 THEN 77 WHEN 1 THEN event_id % 900 + 1 WHEN 3 THEN event_id % 900 + 1 ELSE 0 END::BIGINT AS pid,
        CASE k WHEN 2 THEN 'odd ' WHEN 4 THEN 'plain ' ELSE '' END || 'value ' || event_id AS message, CASE k WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(date_trunc('second', ts)) END AS us FROM e""",
    "rule_catalog": f"""WITH s AS (SELECT * FROM (VALUES {', '.join(f'({k}, {_q(p)}, {_q(m)})' for k, (p, m) in enumerate(SAMPLES))}) t(k, p, m)), r AS (SELECT event_id AS seq, {VERDICT} AS rule FROM events JOIN s ON event_id % {len(SAMPLES)} = k)
        SELECT seq, rule, {OF_RULE('category', 'uncategorised')} AS category, {OF_RULE('outcome', '')} AS outcome FROM r""",
    "ip6_scope": """WITH e AS (SELECT event_id, lower(to_hex(event_id % 65536)) AS x, lower(to_hex(event_id % 65536 + 1)) AS y, event_id % 6 AS k FROM events)
        SELECT event_id, CASE k WHEN 0 THEN '::1' WHEN 1 THEN 'fe80::' || x WHEN 2 THEN 'fd12:3::' || x WHEN 3 THEN '2a00:1450::' || x WHEN 4 THEN 'ff0e::' || y ELSE '::' END AS ip, CASE k WHEN 0 THEN 'loopback' WHEN 1 THEN 'link-local' WHEN 2 THEN 'private' WHEN 3 THEN 'public' WHEN 4 THEN 'multicast' ELSE 'unspecified' END AS scope FROM e""",
    "event_signals": EVENTS + """SELECT count(*) AS event_count, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'notice') AS notice, count(*) FILTER (severity = 'info') AS info,
        max(score) AS peak_score, (SELECT rule FROM v ORDER BY score DESC, seq LIMIT 1) AS peak_rule, 0::BIGINT AS incidents, count(DISTINCT source_ip) FILTER (source_ip <> '') AS sources, 0::BIGINT AS sanitised FROM v""",
    "event_lookup": EVENTS + "SELECT seq, rule, sha256(raw) AS raw_sha256 FROM v WHERE rule = 'new_user_created'",
    "event_news": EVENTS + "SELECT seq, rule FROM v WHERE outcome <> 'failure'",
    "anomaly_cooled": EVENTS + DIMS + """SELECT dim || '=' || value AS key, CASE WHEN baseline_count = 0 THEN 'novel' WHEN spike >= rarity AND spike > 0 THEN 'spike' ELSE 'rare' END AS kind FROM a WHERE greatest(rarity, spike) >= 3.0 AND dim <> 'hour'""",
    "language_floor": """WITH d AS (SELECT doc_id, lang, (doc_id * 7919 % 10007) / 10007.0 AS s FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s DESC, doc_id::VARCHAR) AS n FROM d), k AS (SELECT * FROM r WHERE lang IN ('fr', 'de') AND n <= 2),
        o AS (SELECT * FROM r WHERE NOT coalesce(lang IN ('fr', 'de') AND n <= 2, false) ORDER BY s DESC, doc_id::VARCHAR LIMIT 10 - (SELECT count(*) FROM k)) SELECT doc_id::VARCHAR AS doc_id, lang, round(s, 6) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM o)""",
    "language_mix": "SELECT lang, 'advisory' AS doc_type, count(*) AS n FROM documents GROUP BY lang",
    "ingest_stats": EVENTS + """SELECT count(*) AS events, 0::BIGINT AS incidents, 0::BIGINT AS sanitised, 0::BIGINT AS unparsed, count(*) FILTER (contains(message, '/srv/data/f13') OR contains(message, 'user7')) AS canaries FROM v""",
    "rule_verdict": EVENTS + 'SELECT seq, rule, category, score, severity, outcome, source_ip, dest_ip, source_port, dest_port, "user", n_tags, sha256(raw) AS raw_sha256 FROM v',
    "parse_envelope": EVENTS + "SELECT seq, 'iso8601' AS format, host, process, coalesce(try_cast(pid AS BIGINT), 0) AS pid, message, epoch_us(ts) AS us FROM v",
    "severity_histogram": EVENTS + "SELECT severity, category, count(*) AS n, sum(score)::BIGINT AS total FROM v GROUP BY ALL",
    "ip_scope": rf"""WITH i AS (SELECT doc_id, regexp_extract(text, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b') AS a, regexp_extract(text, '\b(?:[0-9a-fA-F]{{1,4}}:){{2,7}}[0-9a-fA-F]{{1,4}}\b') AS b FROM documents),
        o AS (SELECT doc_id, a AS ip, list_transform(string_split(a, '.'), lambda x: x::INT) AS o FROM i WHERE regexp_full_match(a, '(?:{OCTET}\.){{3}}{OCTET}'))
        SELECT doc_id, ip, CASE WHEN o[1] = 127 THEN 'loopback' WHEN o[1] = 169 AND o[2] = 254 OR o[1] = 224 AND o[2] = 0 AND o[3] = 0 THEN 'link-local' WHEN o[1] = 10 OR o[1] = 172 AND o[2] BETWEEN 16 AND 31 OR o[1] = 192 AND o[2] = 168 THEN 'private'
        WHEN ip = '0.0.0.0' THEN 'unspecified' WHEN o[1] BETWEEN 224 AND 239 THEN 'multicast' ELSE 'public' END AS scope FROM o""",
    "sanitise_flags": r"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, replace(coalesce(text, ''), chr(10), ' ') AS t FROM documents)
        SELECT doc_id, CASE k WHEN 1 THEN ' ' WHEN 4 THEN '\x07' WHEN 5 THEN '\x00' ELSE '' END || t AS clean, k <> 0 AS san_modified, false AS san_truncated, k IN (1, 4, 5) AS san_control, k = 2 AS san_escape, k IN (3, 5) AS san_bidi, false AS san_invalid_utf8 FROM d""",
    "fingerprint_dedupe": "SELECT min(doc_id) AS seq, sha256(coalesce(text, '')) AS raw_sha256 FROM documents GROUP BY 2",
    "sigma_filter": EVENTS + r"""SELECT seq, rule, "user" FROM v WHERE (contains(lower(message), 'failed password') OR contains(lower(message), 'command=') OR dest_port IN (22, 443)) AND NOT ("user" LIKE '%0' OR "user" LIKE '%5')
        AND (regexp_matches(message, 'user[0-9]+') OR regexp_matches(message, 'PROTO=TCP\s+SPT=\d*[02468]\s'))""",
    "canary_hits": EVENTS + """, c AS (SELECT seq, rule, list_filter([CASE WHEN contains(message, '/srv/data/f13') THEN {'t': '/srv/data/f13', 'f': 'message'} END,
        CASE WHEN "user" = 'user7' THEN {'t': 'user7', 'f': 'user'} WHEN contains(message, 'user7') THEN {'t': 'user7', 'f': 'message'} END,
        CASE WHEN "user" = 'user70' THEN {'t': 'user70', 'f': 'user'} WHEN contains(message, 'user70') THEN {'t': 'user70', 'f': 'message'} END], lambda x: x IS NOT NULL) AS h FROM v)
        SELECT seq, 'honeytoken_referenced' AS rule, 100::BIGINT AS score, 'attempt' AS outcome, array_to_string(list_transform(h, lambda x: x.t), ', ') AS tokens, array_to_string(list_transform(h, lambda x: x.f), ', ') AS seen_in, rule AS trigger_rule FROM c WHERE len(h) > 0""",
    "failure_sliding_count": """SELECT event_id, user_id % 12 AS source, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 12 ORDER BY ts RANGE BETWEEN INTERVAL 21599999999 MICROSECONDS PRECEDING AND CURRENT ROW)::BIGINT AS n_failures FROM events""",
    "event_feed": EVENTS + "SELECT seq, rule, score FROM v WHERE score >= 38 AND (contains(lower(message), 'user1') OR contains(lower(rule), 'user1')) ORDER BY seq DESC LIMIT 50",
    "feed_summary": EVENTS + """SELECT 'events' AS metric, '' AS key, count(*) AS n FROM v UNION ALL SELECT 'by_severity', severity, count(*) FROM v GROUP BY 2 UNION ALL SELECT 'by_category', category, count(*) FROM v GROUP BY 2""",
    "top_sources": EVENTS + "SELECT source_ip, count(*) AS n FROM v WHERE source_ip <> '' GROUP BY 1 ORDER BY n DESC, min(seq) LIMIT 10",
    "triage_top": EVENTS + ", q AS (SELECT * FROM v WHERE score >= 40 ORDER BY seq DESC LIMIT 100) SELECT seq, score, severity FROM q ORDER BY rank DESC, score DESC, seq DESC LIMIT 25",
    "log_windows": EVENTS + "SELECT CASE WHEN source_ip <> '' THEN source_ip ELSE 'host:' || host END AS actor, epoch_us(ts) // 600000000 * 600000000 AS bucket_us, count(*) AS events, max(score) AS peak_score, 0::BIGINT AS incidents FROM v GROUP BY ALL",
    "anomaly_scores": EVENTS + DIMS + """SELECT dim, value, n, baseline_count, round(rarity, 6) AS rarity, round(spike, 6) AS spike, CASE WHEN baseline_count = 0 THEN 'novel' WHEN spike >= rarity AND spike > 0 THEN 'spike' ELSE 'rare' END AS kind, peak_score FROM a WHERE greatest(rarity, spike) >= 3.0""",
    "graph_nodes": EVENTS + NODES + """SELECT kind || ':' || label AS id, kind, count(*) AS events, max(score) AS peak_score, ['info', 'notice', 'warning', 'high', 'critical'][max(rank) + 1] AS peak_severity, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM n0 GROUP BY kind, label""",
    "graph_edges": EVENTS + EDGES + "SELECT * FROM g",
    "graph_shapes": EVENTS + EDGES + r"""SELECT 'star' AS name, src AS centre, count(DISTINCT dst) FILTER (dst LIKE 'user:%') AS n, CASE WHEN bool_or(kind = 'auth_success') THEN 'critical' ELSE 'high' END AS severity,
        (70 + least(count(DISTINCT dst) FILTER (dst LIKE 'user:%'), 20) + CASE WHEN bool_or(kind = 'auth_success') THEN 25 ELSE 0 END)::BIGINT AS score FROM g WHERE src LIKE 'source_ip:%' GROUP BY src HAVING count(DISTINCT dst) FILTER (dst LIKE 'user:%') >= 3
        UNION ALL SELECT 'funnel', dst, count(DISTINCT src), 'high', 65 + least(count(DISTINCT src), 25) FROM g WHERE src LIKE 'source_ip:%' AND dst LIKE 'user:%' GROUP BY dst
        UNION ALL SELECT 'bridge', regexp_replace(dst, '\d$', ''), count(DISTINCT src), 'critical', 85 FROM g WHERE src LIKE 'source_ip:%' AND dst LIKE 'user:%' AND grants_access GROUP BY 2 HAVING count(DISTINCT src) >= 2""",
    "reachable": EVENTS.replace("WITH l", "WITH RECURSIVE l", 1) + EDGES + """, x(id, hops) AS (SELECT 'source_ip:203.0.113.3', 0::BIGINT UNION SELECT g.dst, x.hops + 1 FROM x JOIN g ON g.src = x.id AND g.grants_access WHERE x.hops < 3)
        SELECT id, min(hops) AS hops FROM x GROUP BY id""",
    "graph_components": EVENTS.replace("WITH l", "WITH RECURSIVE l", 1).replace("AS rank FROM e)", "AS rank FROM e WHERE outcome = 'failure')") + NODES + EDGES + """, k AS (SELECT DISTINCT kind || ':' || label AS id FROM n0), y AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g),
        x(id, m) AS (SELECT id, id FROM k UNION SELECT x.id, y.b FROM x JOIN y ON y.a = x.m) SELECT id, min(m) AS component FROM x GROUP BY id""",
    "lang_tokens": rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(regexp_replace(coalesce(text, ''), '[^{CJK}]', '', 'g')) AS c FROM documents),
        k AS (SELECT *, length(regexp_replace(t, '{SPACE}', '', 'g')) AS letters, length(regexp_replace(t, '[^{KANA}]', '', 'g')) AS kana, length(regexp_replace(regexp_replace(t, '[^{CJK}]', '', 'g'), '{SPACE}', '', 'g')) AS cjk, (c + (length(t) - c + 3) // 4)::BIGINT AS tokens FROM t)
        SELECT doc_id, CASE WHEN letters > 0 AND (kana >= letters * 0.02 OR cjk >= letters * 0.15) THEN 'ja' ELSE 'en' END AS language, tokens, CASE WHEN tokens = 0 THEN 1600 ELSE greatest(1, floor(400 * greatest(1.0, length(t) / tokens)))::BIGINT END AS chars FROM k""",
    "knn": f"WITH x AS ({VECTORS}), y AS (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM x) SELECT query_id, vec_id, round(s, 6) AS score, rank FROM y WHERE rank <= 5",
    "parent_collapse": f"WITH x AS ({VECTORS} AND a.label IS NOT NULL AND b.label IS NOT NULL), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM x) SELECT query_id, label, arg_min(vec_id, rank) AS vec_id, round(max(s), 6) AS score FROM y WHERE rank <= 32 GROUP BY query_id, label",
    "where_filter": "SELECT lang, source, count(*) AS n FROM documents WHERE (lang IN ('fr', 'de') OR (source IS DISTINCT FROM 'web' AND lang = 'en')) AND (lang NOT IN ('es') OR lang IS NULL) GROUP BY ALL",
    "block_decision": EVENTS + DECIDED.format(allow="true") + "SELECT seq, source_ip, why IS NULL AS allowed, coalesce(why, rule) AS reason FROM c",
    "block_plan": EVENTS + DECIDED.format(allow="false") + ", k AS (SELECT * FROM c WHERE why IS NULL ORDER BY seq LIMIT 8) SELECT min(seq) AS seq, source_ip FROM k WHERE source_ip <> '203.0.113.1' GROUP BY source_ip ORDER BY 1 LIMIT 5",
    "probe_stats": """WITH e AS (SELECT 'probe' || user_id % 7 AS probe, 'probe' || user_id % 5 AS host, epoch_us(ts) AS us, length(props) AS b FROM events)
        SELECT probe, sum(CASE WHEN host = probe THEN 1 ELSE 0 END)::BIGINT AS events, sum(CASE WHEN host <> probe THEN 1 ELSE 0 END)::BIGINT AS rejected, sum(b)::BIGINT AS bytes, min(us) AS first_seen, max(us) AS last_seen FROM e WHERE probe <> 'probe3' GROUP BY probe""",
    "pii_mask": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS (SELECT doc_id, regexp_replace(t, '[\pL\pN_.+-]+@[\pL\pN_-]+\.[\pL\pN_.-]*[\pL\pN_]', 'EMAIL', 'g') AS t FROM t),
        b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\b(?:[0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}\b', 'MAC', 'g'), '\b127(?:\.\d{1,3}){3}\b', 'IP_LOOPBACK', 'g') AS t FROM a)
        SELECT doc_id, sha256(regexp_replace(t, '\b(?:10(?:\.\d{1,3}){3}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2}|192\.168(?:\.\d{1,3}){2}|169\.254(?:\.\d{1,3}){2})\b', 'IP_PRIVATE', 'g')) AS masked FROM b""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
