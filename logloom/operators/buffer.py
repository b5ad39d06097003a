"""The event feed: deduplication, filters, summaries, triage and alert inputs.

``pos`` orders events as they were written. Ties that the first one wins carry it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.sources.schema import is_incident, severity_rank

# Limits of the feed, of triage, of a query and of indicator lists.
CAPACITY, TOP_SOURCES, TRIAGE_SCORE, TRIAGE_POOL = 20_000, 10, 60, 4
QUERY_TAGS, PEAK_CHARS, NO_QUERY = 24, 200, "linux host security event"
INDICATORS = {"source_ips": ("source_ip", 20), "users": ("user", 20), "hosts": ("host", 10), "processes": ("process", 10), "rules": ("rule", 20)}


def dedupe(events: DataFrame, order: str = "seq") -> DataFrame:
    """The first event of each fingerprint, by a map-side combined minimum instead of a sort of whole rows."""
    first = events.groupBy("raw_sha256").agg(F.min(order).alias(order))
    return events.join(first, ["raw_sha256", order], "left_semi").dropDuplicates(["raw_sha256"])


def new_events(events: DataFrame, seen: DataFrame) -> DataFrame:
    return events.join(seen.select("raw_sha256").distinct(), "raw_sha256", "left_anti")


def lookup(events: DataFrame, fingerprints: DataFrame) -> DataFrame:
    return events.join(fingerprints.select("raw_sha256"), "raw_sha256", "left_semi")


def last(events: DataFrame, n: int = CAPACITY, pos: str = "pos") -> DataFrame:
    """The newest ``n`` events (a bounded buffer)."""
    return events.orderBy(F.col(pos).desc()).limit(n)


def feed(events: DataFrame, limit: int = 100, min_score: int = 0, severity: str = "", category: str = "", source_ip: str = "", rule: str = "", incidents_only: bool = False, search: str = "", pos: str = "pos") -> DataFrame:
    """Matching events, newest first: filters reach the scan, the order is a top-k."""
    d = events.where(F.col("score") >= min_score) if min_score else events
    for name, value in (("severity", severity), ("category", category), ("source_ip", source_ip), ("rule", rule)):
        d = d.where(F.col(name) == value) if value else d
    d = d.where(is_incident()) if incidents_only else d
    if search:
        needle = search.lower()
        d = d.where(F.lower("message").contains(needle) | F.lower("rule").contains(needle))
    return d.orderBy(F.col(pos).desc()).limit(limit)


def summary(events: DataFrame) -> DataFrame:
    """``metric, key, n``: all events, incidents, sanitised lines, counts by severity and category; one pass."""
    flags = F.array(
        F.struct(F.lit("events").alias("metric"), F.lit("").alias("key")),
        F.when(is_incident(), F.struct(F.lit("incidents").alias("metric"), F.lit("").alias("key"))),
        F.when(F.col("sanitized"), F.struct(F.lit("sanitised_lines").alias("metric"), F.lit("").alias("key"))),
        F.struct(F.lit("by_severity").alias("metric"), F.col("severity").alias("key")), F.struct(F.lit("by_category").alias("metric"), F.col("category").alias("key")),
    )
    return events.select(F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("x")).groupBy("x.metric", "x.key").agg(F.count("*").alias("n"))


def top_sources(events: DataFrame, n: int = TOP_SOURCES, pos: str = "pos") -> DataFrame:
    """``source_ip, n``: the busiest sources, the one seen first before its equals."""
    g = events.where("source_ip <> ''").groupBy("source_ip").agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return g.orderBy(F.col("n").desc(), "first").limit(n).drop("first")


def triage(events: DataFrame, limit: int = 25, min_score: int = TRIAGE_SCORE, pos: str = "pos") -> DataFrame:
    """The gravest of the newest events above the score, in the order of time."""
    pool = feed(events, limit * TRIAGE_POOL, min_score, pos=pos)
    top = pool.orderBy(severity_rank(F.col("severity")).desc(), F.col("score").desc(), F.col(pos).desc()).limit(limit)
    return top.orderBy("timestamp", "seq")


def _unique(value: Column, pos: str, cond: Column | None = None) -> Column:
    """Distinct values in order of first appearance; for the few events of an alert."""
    rows = F.array_sort(F.collect_list(F.when(value != "" if cond is None else cond, F.struct(F.col(pos).alias("p"), value.alias("v")))))
    return F.array_distinct(F.transform(rows, lambda r: r["v"]))


def indicators(events: DataFrame, pos: str = "pos") -> DataFrame:
    """One row of ordered, distinct, capped lists over the (at most a few dozen) events of an alert."""
    lists = [F.slice(_unique(F.col(c), pos), 1, n).alias(k) for k, (c, n) in INDICATORS.items()]
    return events.agg(*lists, F.count("*").alias("event_count"), F.coalesce(F.max("score"), F.lit(0)).alias("peak_score"))


def signals(events: DataFrame, pos: str = "pos") -> DataFrame:
    """One row of facts computed for an analyst: counts, histogram, peak, incidents."""
    peak = F.max_by(F.struct("score", "severity", "rule"), F.struct(F.col("score"), -F.col(pos)))
    hist = [F.sum(F.when(F.col("severity") == s, 1).otherwise(0)).alias(s) for s in ("critical", "high", "warning", "notice", "info")]
    return events.agg(F.count("*").alias("event_count"), *hist, peak.alias("peak"), F.sum(F.when(is_incident(), 1).otherwise(0)).alias("incidents"),
                      F.countDistinct(F.when(F.col("source_ip") != "", F.col("source_ip"))).alias("sources"), F.sum(F.when(F.col("sanitized"), 1).otherwise(0)).alias("sanitised"))


def query_text(events: DataFrame, question: str = "", pos: str = "pos") -> DataFrame:
    """One row ``query``: rules, categories, techniques and tags rather than raw lines."""
    flat = lambda col: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(col).alias("v")))), lambda r: r["v"])))
    d = events.agg(_unique(F.col("rule"), pos).alias("r"), _unique(F.col("category"), pos).alias("c"), flat("mitre").alias("m"), F.filter(flat("tags"), lambda t: ~t.startswith("scope:")).alias("t"),
                   F.max_by("message", F.struct(F.col("score"), -F.col(pos))).alias("peak"))
    part = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(name), F.array_join(xs, ", ")))
    q = question.strip()
    text = F.concat_ws("\n", F.lit(q or None), part("detections: ", F.col("r")), part("categories: ", F.col("c")), part("MITRE ATT&CK: ", F.col("m")), part("indicators: ", F.slice("t", 1, QUERY_TAGS)),
                       F.concat(F.lit("most severe event: "), F.substring("peak", 1, PEAK_CHARS)))
    return d.select(F.when(text == "", NO_QUERY).otherwise(text).alias("query"))


def alert_id(events: DataFrame, question: str = "", pos: str = "pos") -> DataFrame:
    """One row ``alert_id`` that depends on the question and the fingerprints in order only."""
    prints = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("raw_sha256").alias("v")))), lambda r: r["v"])
    return events.agg(F.concat(F.lit("alert-"), F.substring(F.sha2(F.concat(F.lit(question), F.array_join(prints, "")), 256), 1, 16)).alias("alert_id"))


def with_pos(events: DataFrame) -> DataFrame:
    """A position that sorts like the file: by sequence number, an event before its incidents."""
    return events.withColumn("pos", F.col("seq") * 2 + F.when(is_incident(), 1).otherwise(0))


def per_key(events: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key."""
    return events.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_k") <= n).drop("_k")
