"""Raw lines to events and incidents: one fused projection, then one shuffle by source."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import MAX_LINE, sanitise
from logloom.operators import correlate as C
from logloom.operators.canary import Canaries
from logloom.operators.enrich import enrich
from logloom.operators.parse import parse
from logloom.operators.sigma import SigmaRule
from logloom.sources.lines import read_lines, with_seq
from logloom.sources.schema import is_incident


@dataclass
class Options:
    max_line: int = MAX_LINE
    min_score: int = 0
    now: datetime | None = None
    zone: str = "UTC"
    keep_raw: bool = False
    canaries: Canaries | None = None
    sigma: Sequence[SigmaRule] = ()
    correlator: C.Config | None = field(default_factory=C.Config)
    columns: Sequence[str] | None = None  # of the events; the others are not computed


def to_events(lines: DataFrame, options: Options | None = None) -> DataFrame:
    """Events of rows with ``seq, raw`` (text or bytes); a projection without a shuffle."""
    o = options or Options()
    # HotSpot compiles no method of more bytes: the fused projection would be interpreted for every line, unfused it is split
    lines.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    lines = lines.withColumn("raw", F.col("raw").cast("string"))
    d = parse(sanitise(lines, "raw", o.max_line), "clean", o.now, o.zone)
    return enrich(d, o.canaries, o.sigma, o.now, keep_raw=o.keep_raw, columns=o.columns)


def with_incidents(events: DataFrame, options: Options | None = None) -> DataFrame:
    """Events and the incidents they make; the correlator sees what the score filter drops."""
    o = options or Options()
    out = events if o.correlator is None else events.unionByName(C.incidents(events, o.correlator))
    return C.at_least(out, o.min_score) if o.min_score else out


def ingest(spark: SparkSession, path: str, options: Options | None = None) -> DataFrame:
    o = options or Options()
    return with_incidents(to_events(with_seq(read_lines(spark, path, o.max_line)), o), o)


def in_order(events: DataFrame) -> DataFrame:
    """As written: by sequence number, an event before its incidents."""
    return events.orderBy("seq", is_incident())


def run_stats(events: DataFrame) -> DataFrame:
    """One row: events, incidents, sanitised, unparsed, canary hits."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    real = ~is_incident()
    return events.agg(n(real).alias("events"), n(is_incident()).alias("incidents"), n(real & F.col("sanitized")).alias("sanitised"), n(real & ~F.col("parse_ok")).alias("unparsed"), n(F.col("category") == "deception").alias("canaries"))
