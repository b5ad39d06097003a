"""Tumbling windows of events by actor, rendered as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.sources.schema import event_time, is_incident

MINUTES = 10
SOURCE = "log-ingest"


def actor() -> Column:
    host = F.when(F.col("host") == "", "unknown").otherwise(F.col("host"))
    return F.when(F.col("source_ip") != "", F.col("source_ip")).otherwise(F.concat(F.lit("host:"), host))


def stamp(ts: Column, chars: int = 19) -> Column:
    return F.coalesce(F.substring(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 1, chars), F.lit(""))


def render(ts: Column | None = None) -> Column:
    """An event as text: severity, place and message, detection, techniques, entities, tags."""
    at = F.when(F.col("timestamp").isNull(), "").otherwise(F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))) if ts is None else ts
    port = lambda c: F.when(F.col(c) == 0, "-").otherwise(F.col(c).cast("string"))
    some = lambda c, text: F.when(F.col(c) != "", text)
    head = F.concat(F.lit("["), F.upper("severity"), F.lit(" "), F.col("score").cast("string"), F.lit("] "), F.concat_ws(" ", at, "host", "process"), F.lit(": "), "message")
    bits = F.concat_ws(" ", some("source_ip", F.concat(F.lit("source="), "source_ip", F.lit(":"), port("source_port"))), some("dest_ip", F.concat(F.lit("destination="), "dest_ip", F.lit(":"), port("dest_port"))),
                       some("user", F.concat(F.lit("user="), "user")), some("outcome", F.concat(F.lit("outcome="), "outcome")))
    return F.concat_ws("\n", head, some("rule", F.concat(F.lit("detection: "), "rule", F.lit(" ("), "category", F.lit(")"))),
                       F.when(F.size("mitre") > 0, F.concat(F.lit("MITRE ATT&CK: "), F.array_join("mitre", ", "))), F.when(bits != "", bits), F.when(F.size("tags") > 0, F.concat(F.lit("tags: "), F.array_join("tags", ", "))))


def windowed(events: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """Events with ``actor`` and ``bucket``, the start of their window (null without a time)."""
    if minutes <= 0:
        raise ValueError("minutes must be positive")
    span = minutes * 60
    at = F.floor(F.unix_micros(event_time()) / F.lit(span * 1_000_000)) * span
    return events.withColumn("actor", actor()).withColumn("bucket", F.timestamp_seconds(at))


def counts(events: DataFrame, minutes: int = MINUTES) -> DataFrame:
    """``actor, bucket, events, peak_score, incidents``: the windows without their texts; map-side combined."""
    return windowed(events, minutes).groupBy("actor", "bucket").agg(F.count("*").alias("events"), F.max("score").alias("peak_score"), F.sum(F.when(is_incident(), 1).otherwise(0)).alias("incidents"))


def documents(events: DataFrame, minutes: int = MINUTES, part: int = 20_000) -> DataFrame:
    """Window documents: ``doc_id, title, text, source, lang, doc_type, metadata``.

    A window is as large as what its actor did in it; a flood of more than ``part`` events
    becomes several documents of consecutive events, all of which together hold every event.
    """
    d = windowed(events, minutes)
    key = ["actor", "bucket"]
    size = d.groupBy(*key).agg(F.count("*").alias("_n"), F.min("seq").alias("_lo"), F.max("seq").alias("_hi"))
    # slices of equal spans of the sequence: no sort of the hot window in one task
    sliced = d.join(size, (d["actor"] == size["actor"]) & d["bucket"].eqNullSafe(size["bucket"])).drop(size["actor"]).drop(size["bucket"])
    pieces = F.ceil(F.col("_n") / part)
    sliced = sliced.withColumn("slice", F.when(pieces <= 1, 0).otherwise(F.floor((F.col("seq") - F.col("_lo")) * pieces / (F.col("_hi") - F.col("_lo") + 1)).cast("int")))
    pos = F.struct("seq", is_incident().alias("i"))
    some = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    g = sliced.groupBy(*key, "slice").agg(
        F.array_sort(F.collect_list(F.struct(pos.alias("p"), render().alias("t")))).alias("body"), F.count("*").alias("n"),
        F.min_by(F.struct("timestamp", "raw_sha256"), pos).alias("first"), F.max_by("timestamp", pos).alias("last"),
        # the first of the highest score
        F.max_by(F.struct("severity", "score"), F.struct(F.col("score"), -F.col("seq"), ~is_incident())).alias("peak"),
        some("category").alias("categories"), some("rule").alias("rules"), flat("mitre").alias("mitre"), some("user").alias("users"), flat("tags").alias("tags"), some("host").alias("hosts"),
        F.sum(F.when(is_incident(), 1).otherwise(0)).alias("incidents"))
    join = lambda c, empty="none": F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(empty)
    title = F.concat(F.lit("Log window "), stamp(F.col("first.timestamp")), F.lit(" .. "), stamp(F.col("last")), F.lit(" — "), "actor", F.lit(" — "), F.col("n").cast("string"), F.lit(" events, peak "), "peak.severity", F.lit(" ("), F.col("peak.score").cast("string"), F.lit(")"))
    head = F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("source: "), "actor"), F.concat(F.lit("hosts: "), join("hosts", "unknown")), F.concat(F.lit("categories: "), join("categories")), F.concat(F.lit("detections: "), join("rules")),
                       F.concat(F.lit("MITRE ATT&CK: "), join("mitre")), F.concat(F.lit("users referenced: "), join("users")), F.concat(F.lit("tags: "), join("tags")), F.concat(F.lit("correlated incidents: "), F.col("incidents").cast("string")), F.lit(""), F.lit("## Events"))
    meta = F.create_map(*[x for k, v in {
        "actor": F.col("actor"), "event_count": F.col("n").cast("string"), "peak_score": F.col("peak.score").cast("string"), "peak_severity": F.col("peak.severity"), "incident_count": F.col("incidents").cast("string"),
        "categories": F.array_join("categories", ", "), "rules": F.array_join("rules", ", "), "mitre": F.array_join("mitre", ", "), "first_seen": stamp(F.col("first.timestamp")), "last_seen": stamp(F.col("last")), "hosts": F.array_join("hosts", ", ")}.items() for x in (F.lit(k), v)])
    out = g.withColumn("title", title)
    return out.select(F.concat(F.lit("events:"), "actor", F.lit(":"), stamp(F.col("first.timestamp"), 16), F.lit(":"), F.substring("first.raw_sha256", 1, 12)).alias("doc_id"), "title",
                      F.concat(head, F.lit("\n"), F.array_join(F.transform("body", lambda b: b["t"]), "\n\n")).alias("text"), F.lit(SOURCE).alias("source"), F.lit("en").alias("lang"), F.lit("log_window").alias("doc_type"), meta.alias("metadata"))
