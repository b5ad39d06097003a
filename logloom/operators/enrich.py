"""From parsed lines to scored events: rules, imported rules, modifiers, canaries, severity.

The order is the meaning: the rule verdict, the first address of the text, imported
rules, modifiers, canaries, then clamping. All of it is one projection over a line.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import ip
from logloom.functions.text import field, fingerprint
from logloom.operators import rules as R
from logloom.operators.canary import Canaries
from logloom.operators.sigma import SigmaRule, sigma_field
from logloom.sources.schema import complete, severity_for

# Score changes, their reasons, tags that go with them.
UNMATCHED = ("uncategorised", 5)
SCOPE_DELTA = {"public": (8, "public_source"), "loopback": (-8, "loopback_source"), "private": (-4, "private_source")}
ROOT = (10, "root_involved")
SYSLOG_CRITICAL = (10, "syslog_critical", "syslog-critical")
INJECTION = (25, "log_injection_indicator", ("log-injection", "ログインジェクション", "input-sanitised", "入力無害化"))
INVALID = (5, "invalid_utf8", ("invalid-encoding", "不正エンコーディング"))
TRUNCATED = ("truncated", "切り詰め")
UNPARSED = ("unparsed", "解析不能")
CANARY_TAGS = ("honeytoken", "ハニートークン", "deception", "デセプション", "canary", "カナリア", "high-confidence", "高信頼度")
CANARY_RULE = "honeytoken_referenced"
FIRST_CLASS = ("user", "ip", "dest_ip", "port", "dest_port")


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _tags_if(cond: Column, values) -> Column:
    return F.when(cond, _texts(values)).otherwise(_texts(()))


def _port(c: Column) -> Column:
    n = F.when(c.rlike(r"\A[0-9]{1,9}\z"), c.cast("int"))
    return F.when(n.between(1, 65535), n).otherwise(0)


def enrich(df: DataFrame, canaries: Canaries | None = None, sigma: Sequence[SigmaRule] = (), now: datetime | None = None, rules: Sequence[R.Rule] = R.RULES, keep_raw: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Events of rows with ``seq, raw, clean`` and the columns of the sanitiser and the parser; lines without a time take ``now`` (default: the query's time).

    ``columns`` are those that are wanted (default: all): the others are not computed, which
    the optimiser can't find out behind the fence.
    """
    stamp = F.lit(now) if now else F.current_timestamp()
    message, process = F.col("env_message"), F.col("env_process")
    d = df.withColumn("_low", R.folded(message))
    d = d.withColumn("_hits", R.matches(rules, message, F.col("_low"), process))
    d = d.withColumn("_win", F.try_element_at("_hits", F.lit(1)))
    win = F.col("_win")

    def of(values, kind: str) -> Column:
        return F.try_element_at(F.array(*[F.lit(v) if not isinstance(v, tuple) else _texts(v) for v in values]).cast(f"array<{kind}>"), win + 1)

    names = R.capture_names(rules)
    d = d.withColumns({f"_raw_{n}": R.capture(rules, n, message, win) for n in names})
    d = d.withColumns({f"_cap_{n}": field(F.col(f"_raw_{n}"), 256) for n in names})
    cap = lambda n: F.col(f"_cap_{n}") if n in names else F.lit("")
    d = d.withColumn("_src", F.when(ip.is_ip(cap("ip")), cap("ip")).otherwise(ip.first_ip(message)))
    sans = [c for c in d.columns if c.startswith(("san_", "env_"))]
    all_tags = F.array(*[_texts(r.tags) for r in rules])
    d = d.select(
        "seq", "raw", "clean", *sans,
        fingerprint(F.col("raw")).alias("raw_sha256"), field(F.col("env_host"), 253).alias("host"), field(F.col("env_process"), 64).alias("process"),
        F.coalesce(of([r.name for r in rules], "string"), F.lit("")).alias("rule"),
        F.coalesce(of([r.category for r in rules], "string"), F.lit(UNMATCHED[0])).alias("category"),
        F.coalesce(of([r.score for r in rules], "int"), F.lit(UNMATCHED[1])).alias("score"),
        F.coalesce(of([r.outcome for r in rules], "string"), F.lit("")).alias("outcome"),
        F.coalesce(of([r.mitre for r in rules], "array<string>"), _texts(())).alias("mitre"),
        F.array_distinct(F.concat(_tags_if(F.col("env_time").isNull(), ["no-timestamp"]), F.flatten(F.transform("_hits", lambda i: F.element_at(all_tags, i + 1))))).alias("tags"),
        F.col("_src").alias("source_ip"), _port(cap("port")).alias("source_port"),
        F.when(ip.is_ip(cap("dest_ip")), cap("dest_ip")).otherwise("").alias("dest_ip"), _port(cap("dest_port")).alias("dest_port"), cap("user").alias("user"), cap("target_user").alias("_target"),
        F.array(F.struct(F.lit("format").alias("k"), F.col("env_format").alias("v")), *[F.struct(F.lit(n).alias("k"), cap(n).alias("v")) for n in names if n not in FIRST_CLASS]).alias("pairs"),
        win.isNotNull().alias("_matched"),
    )
    d = _sigma(d, sigma)
    d = _modifiers(d)
    d = _canaries(d, canaries)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.col("score")))
    tags = F.array_distinct(F.concat("tags", F.array("category"), F.when(F.col("source_ip") != "", F.array(F.concat(F.lit("scope:"), F.col("_scope")))).otherwise(_texts(()))))
    out = d.select(
        "seq", "raw_sha256", stamp.alias("ingested_at"), F.coalesce(F.col("env_time"), stamp).alias("timestamp"), "host", F.col("env_facility").alias("facility"), "process",
        F.col("env_pid").alias("pid"), F.col("env_message").alias("message"), "category", severity_for(score).alias("severity"), score.alias("score"), "rule", "outcome",
        F.array_distinct("mitre").alias("mitre"), tags.alias("tags"), "source_ip", "source_port", "dest_ip", "dest_port", "user",
        F.map_from_entries(F.filter("pairs", lambda p: p["v"] != "")).alias("fields"), F.col("san_modified").alias("sanitized"), (F.col("env_format") != "raw").alias("parse_ok"),
        (F.col("clean") if keep_raw else F.lit("")).alias("raw"),
    )
    out = complete(out)
    return fence(out.select(*columns) if columns else out)


def fence(df: DataFrame) -> DataFrame:
    """The same rows behind a generator that predicates don't pass.

    Pushed down, a filter on a verdict would be replaced by the definition of every column
    that it rests on, through all projections, and grow without bound.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _get(name: str) -> Column:
    """A value among the pairs, '' if it isn't there."""
    return F.coalesce(F.try_element_at(F.transform(F.filter("pairs", lambda p: p["k"] == name), lambda p: p["v"]), F.lit(1)), F.lit(""))


def _pair(k: str, v) -> Column:
    return F.struct(F.lit(k).alias("k"), F.coalesce(v, F.lit("")).alias("v"))


def _sigma(d: DataFrame, sigma: Sequence[SigmaRule]) -> DataFrame:
    """Imported rules: attribution always merges; the verdict goes over only to a higher score, the outcome only where there is none."""
    if not sigma:
        return d
    each = []
    for i, s in enumerate(sigma):
        cond = s.condition(lambda name: sigma_field(name, _get))
        each.append(F.when(R.process_in(F.col("env_process"), s.processes) & cond if s.processes else cond, F.lit(i)))
    d = d.withColumn("_s", F.coalesce(*each))
    pick = lambda values, kind: F.try_element_at(F.array(*values).cast(f"array<{kind}>"), F.col("_s") + 1)
    lits = lambda attr: [F.lit(getattr(s, attr)) for s in sigma]
    hit = F.col("_s").isNotNull()
    d = d.withColumn("_take", F.coalesce(hit & (~F.col("_matched") | (pick(lits("score"), "int") > F.col("score"))), F.lit(False)))
    take = F.col("_take")
    pairs = F.concat("pairs", F.array(
        _pair("sigma_rule", pick(lits("name"), "string")), _pair("sigma_title", pick(lits("title"), "string")), _pair("sigma_source", pick(lits("source"), "string")),
        _pair("sigma_id", pick(lits("sigma_id"), "string")), _pair("builtin_rule", F.when(take & F.col("_matched"), F.col("rule")))))
    return d.withColumns({
        "mitre": F.when(hit, F.array_distinct(F.concat("mitre", pick([_texts(s.mitre) for s in sigma], "array<string>")))).otherwise(F.col("mitre")),
        "tags": F.when(hit, F.array_distinct(F.concat("tags", pick([_texts(s.tags) for s in sigma], "array<string>")))).otherwise(F.col("tags")),
        "pairs": pairs,
        "rule": F.when(take, pick(lits("name"), "string")).otherwise(F.col("rule")),
        "category": F.when(take, pick(lits("category"), "string")).otherwise(F.col("category")),
        "score": F.when(take, pick(lits("score"), "int")).otherwise(F.col("score")),
        "outcome": F.when(take & (F.col("outcome") == ""), pick(lits("outcome"), "string")).otherwise(F.col("outcome")),
    })


def _modifiers(d: DataFrame) -> DataFrame:
    d = d.withColumn("_scope", F.when(F.col("source_ip") != "", ip.scope(F.col("source_ip"))).otherwise(""))
    san, level = {k: F.col(f"san_{k}") for k in ("control", "escape", "bidi", "invalid_utf8", "truncated")}, F.col("env_level")
    injected = san["control"] | san["escape"] | san["bidi"]
    root = (F.lower("user") == "root") | (F.lower("_target") == "root")
    changes = [(F.col("_scope") == s, n, why) for s, (n, why) in SCOPE_DELTA.items()]
    changes += [(root, *ROOT), (level.between(0, 2), *SYSLOG_CRITICAL[:2]), (injected, *INJECTION[:2]), (san["invalid_utf8"], *INVALID[:2])]
    score, notes = F.col("score"), []
    for cond, n, why in changes:
        score = score + F.when(cond, n).otherwise(0)
        notes.append(_pair(f"score_{why}", F.when(cond, F.lit(f"{n:+d}"))))
    tags = [_tags_if(level.between(0, 2), SYSLOG_CRITICAL[2:]), _tags_if(injected, INJECTION[2]), _tags_if(san["invalid_utf8"], INVALID[2]), _tags_if(san["truncated"], TRUNCATED), _tags_if(F.col("env_format") == "raw", UNPARSED)]
    return d.withColumns({
        "score": score, "pairs": F.concat("pairs", F.array(*notes)), "tags": F.array_distinct(F.concat("tags", *tags)),
        "category": F.when(injected, "defense-evasion").otherwise(F.col("category")),
        "rule": F.when(injected & (F.col("rule") == ""), "sanitizer_anomaly").otherwise(F.col("rule")),
    })


def _canaries(d: DataFrame, canaries: Canaries | None) -> DataFrame:
    """A canary replaces the verdict; the rule that matched stays as ``trigger_rule``."""
    if canaries is None or not canaries.tokens:
        return d
    d = d.withColumn("_h", canaries.hits(F.col("user"), F.col("_target"), F.col("env_message")))
    hit = F.size("_h") > 0
    joined = lambda key: F.when(hit, F.array_join(F.transform("_h", lambda h: h[key]), ", "))
    notes = F.filter(F.transform("_h", lambda h: h["note"]), lambda n: n != "")
    extra = F.array(_pair("honeytoken_note", F.try_element_at(notes, F.lit(-1))), _pair("score_honeytoken", F.when(hit, F.lit("=100"))), _pair("trigger_rule", F.when(hit, F.col("rule"))),
                    _pair("honeytoken", joined("value")), _pair("honeytoken_kind", joined("kind")), _pair("honeytoken_field", joined("field")))
    mitre = F.concat("mitre", F.array(F.lit("T1087.001")), F.when(F.exists("_h", lambda h: h["kind"] == "path"), _texts(["T1083"])).otherwise(_texts(())))
    return d.withColumns({
        "score": F.when(hit, 100).otherwise(F.col("score")), "category": F.when(hit, "deception").otherwise(F.col("category")), "outcome": F.when(hit, "attempt").otherwise(F.col("outcome")),
        "rule": F.when(hit, CANARY_RULE).otherwise(F.col("rule")), "pairs": F.concat("pairs", extra), "mitre": F.when(hit, F.array_distinct(mitre)).otherwise(F.col("mitre")),
        "tags": F.when(hit, F.array_distinct(F.concat("tags", _texts(CANARY_TAGS)))).otherwise(F.col("tags")),
    })
