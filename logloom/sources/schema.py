"""The event row, and JSON lines in and out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS: dict[str, str] = {
    "seq": "bigint", "raw_sha256": "string", "ingested_at": "timestamp", "timestamp": "timestamp", "host": "string", "facility": "string",
    "process": "string", "pid": "int", "message": "string", "category": "string", "severity": "string", "score": "int", "rule": "string",
    "outcome": "string", "mitre": "array<string>", "tags": "array<string>", "source_ip": "string", "source_port": "int", "dest_ip": "string",
    "dest_port": "int", "user": "string", "fields": "map<string,string>", "sanitized": "boolean", "parse_ok": "boolean", "raw": "string",
}
DDL = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())
#: Values of columns that a record lacks; the wire format leaves out what is empty.
DEFAULTS = {"category": "uncategorised", "severity": "info"}
#: The process under which synthetic incidents are reported.
CORRELATOR = "correlator"
# Lower bounds of the severities.
SEVERITIES = (("critical", 80), ("high", 60), ("warning", 40), ("notice", 20), ("info", 0))


def severity_for(score: Column) -> Column:
    out = F.lit("info")
    for name, least in reversed(SEVERITIES[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    """4 for critical down to 0 for info and for anything unknown."""
    out = F.when(severity == "info", 0)
    for rank, (name, _) in enumerate(reversed(SEVERITIES)):
        out = out.when(severity == name, rank)
    return out.otherwise(0)


def is_incident() -> Column:
    return (F.col("process") == CORRELATOR) | F.col("rule").startswith("correlated_")


def event_time() -> Column:
    return F.coalesce("timestamp", "ingested_at")


def empty_of(kind: str) -> Column:
    if kind == "string":
        return F.lit("")
    if kind.startswith("array"):
        return F.array().cast(kind)
    if kind.startswith("map"):
        return F.create_map().cast(kind)
    return F.lit(False if kind == "boolean" else 0).cast(kind)


def complete(df: DataFrame) -> DataFrame:
    """All event columns with the declared types, nulls (but those of times) as the empty values."""
    have = set(df.columns)
    out = []
    for name, kind in COLUMNS.items():
        empty = F.lit(DEFAULTS[name]) if name in DEFAULTS else empty_of(kind)
        c = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        out.append((c if kind == "timestamp" else F.coalesce(c, empty)).alias(name))
    return df.select(*out)


def parse_events(lines: DataFrame, col: str = "value") -> DataFrame:
    """Events from JSON texts: what is blank, malformed or no object is skipped; wrong types become the empty value."""
    v = F.try_parse_json(F.col(col))
    rows = lines.where(F.trim(F.col(col)) != "").withColumn("v", v).where(F.schema_of_variant("v").startswith("OBJECT"))

    def get(name: str, kind: str) -> Column:
        path = f"$.{name}"
        if kind == "timestamp":
            return F.try_to_timestamp(F.try_variant_get("v", path, "string"))
        return F.try_variant_get("v", path, kind)

    return complete(rows.select(*[get(k, t).alias(k) for k, t in COLUMNS.items()]))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.read.option("lineSep", "\n").text(path))


def to_json(df: DataFrame) -> DataFrame:
    """One compact JSON text a row as ``value``; empty values are left out, as are times without a value."""
    always = {"seq", "raw_sha256", "ingested_at", "message", "category", "severity", "score", "sanitized", "parse_ok"}
    cols = []
    for name, kind in COLUMNS.items():
        c = F.col(name)
        if kind == "timestamp":
            text = F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            c = F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("Z"))
        elif name not in always:
            c = F.when(F.size(c) > 0 if kind.startswith(("array", "map")) else c != empty_of(kind), c)
        cols.append(c.alias(name))
    return df.select(F.to_json(F.struct(*cols)).alias("value"))


def write_events(df: DataFrame, path: str, mode: str = "append") -> None:
    to_json(df).write.mode(mode).text(path)
