"""Syslog envelopes: RFC 5424, ISO 8601, RFC 3164, or a bare tag, as one projection."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.regex import Pattern, to_java

# The formats and the facility names by number.
PRI = r"^<(\d{1,3})>"
RFC5424 = r"^1 (?P<ts>\S+) (?P<host>\S+) (?P<app>\S+) (?P<procid>\S+) (?P<msgid>\S+) (?:\[[^\]]*\]|-) ?(?P<msg>.*)$"
ISO8601 = r"^(?P<ts>\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?) +(?P<rest>.*)$"
RFC3164 = r"^(?P<ts>[A-Z][a-z]{2} {1,2}\d{1,2} \d{2}:\d{2}:\d{2}) +(?P<rest>.*)$"
TAG = r"^(?P<tag>[A-Za-z0-9_./\-]+)(?:\[(?P<pid>\d+)\])?: ?(?P<msg>.*)$"
TAG_HEAD = r"^[A-Za-z0-9_./\-]+(?:\[\d+\])?: ?(?=.*$)"
PLAIN_TIME = r"^[12]\d{3}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z$"
FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp audit alert clock local0 local1 local2 local3 local4 local5 local6 local7".split()
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def _get(text: Column, p: Pattern, name: str) -> Column:
    return F.regexp_extract(text, p.text, p.group(name))


def iso_time(text: Column) -> Column:
    """A UTC timestamp, or null: no zone is UTC; a blank before the time goes with no ``Z`` and no zone without colon."""
    shape = to_java(r"^(\d{4})-(\d{2})-(\d{2})([T ])(\d{2}):(\d{2}):(\d{2})(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$").text
    part = lambda i: F.regexp_extract(text, shape, i)
    num = lambda i: part(i).try_cast("int")
    zone = part(9)
    sec = F.concat(part(7), F.substring(part(8), 1, 7)).try_cast("decimal(8,6)")
    at = F.try_make_timestamp(num(1), num(2), num(3), num(5), num(6), sec, F.lit("UTC"))
    digits = F.regexp_replace(zone, ":", "")
    minutes = F.when(F.length(digits) == 5, F.substring(digits, 2, 2).cast("int") * 60 + F.substring(digits, 4, 2).cast("int")).otherwise(0)
    shift = F.when(zone.startswith("-"), -minutes).otherwise(minutes)
    good = text.rlike(shape) & (num(7) < 60) & ((part(4) == "T") | (zone == "") | zone.contains(":"))
    # the usual form is read by one cast, which gives null for the same dates and times that aren't any
    return F.when(text.rlike(to_java(PLAIN_TIME).text), text.try_cast("timestamp")).when(good, F.timestamp_micros(F.unix_micros(at) - shift.cast("bigint") * 60_000_000))


def bsd_time(text: Column, now: datetime, zone: str) -> Column:
    """The time in ``zone``, of the year next to ``now``: a month more than one ahead is last year's, January in December next year's."""
    here = now.astimezone(ZoneInfo(zone))
    shape = to_java(r"^([A-Z][a-z]{2}) {1,2}(\d{1,2}) (\d{2}):(\d{2}):(\d{2})$").text
    part = lambda i: F.regexp_extract(text, shape, i)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(1)).cast("int")
    day, hour, minute, sec = (part(i).try_cast("int") for i in (2, 3, 4, 5))
    ahead = month - F.lit(here.month)
    year = F.lit(here.year) + F.when(ahead > 1, -1).when(ahead < -10, 1).otherwise(0)
    make = lambda m, d: F.try_make_timestamp(year, m, d, hour, minute, sec.cast("decimal(8,6)"), F.lit(zone))
    # 29 February is a date of the year-less format; in another year it is 1 March
    leap = (month == 2) & (day == 29)
    at = F.when(leap, F.coalesce(make(month, day), make(F.lit(3), F.lit(1)))).otherwise(make(month, day))
    return F.when((month > 0) & (sec < 60), at)


def parse(df: DataFrame, text: str = "clean", now: datetime | None = None, zone: str = "UTC") -> DataFrame:
    """Adds ``env_``: format, facility, level (-1 if none), time (null if none), host, process, pid, message. Nothing is dropped."""
    now = now or datetime.now(ZoneInfo("UTC"))
    r5424, iso, r3164, tag = (to_java(p) for p in (RFC5424, ISO8601, RFC3164, TAG))
    line = F.col(text)
    pri = F.regexp_extract(line, to_java(PRI).text, 1)
    d = df.withColumn("_pri", F.when(line.startswith("<"), pri).otherwise(F.lit("")))
    d = d.withColumn("_rest", F.when(F.col("_pri") != "", F.substring(line, F.length("_pri") + 3, F.length(line))).otherwise(line)).withColumn("_n", F.col("_pri").try_cast("int"))
    rest = F.col("_rest")
    # one match a format: its time isn't empty, and what follows the time and blanks is the rest
    d = d.withColumn("_five", rest.startswith("1 ") & rest.rlike(r5424.text))
    d = d.withColumn("_iso", F.when(F.col("_five"), "").otherwise(_get(rest, iso, "ts")))
    d = d.withColumn("_bsd", F.when(F.col("_five") | (F.col("_iso") != ""), "").otherwise(_get(rest, r3164, "ts")))
    kind = F.when(F.col("_five"), "rfc5424").when(F.col("_iso") != "", "iso8601").when(F.col("_bsd") != "", "rfc3164").otherwise("raw")
    d = d.withColumn("_kind", kind)
    k = F.col("_kind")
    d = d.withColumn("_ts", F.when(k == "rfc5424", _get(rest, r5424, "ts")).otherwise(F.concat("_iso", "_bsd")))
    d = d.withColumn("_body", F.when(k.isin("iso8601", "rfc3164"), F.ltrim(F.substring(rest, F.length("_ts") + 1, F.length(rest)))).otherwise(rest))
    body = F.col("_body")
    first = F.substring_index(body, " ", 1)
    # "app[pid]: text" without a host; a line with a time needs a blank to be split at all
    no_host = (k == "raw") | ((first.endswith(":") | first.contains("[")) & body.rlike(tag.text))
    d = d.withColumn("_split", (k == "raw") | body.contains(" ")).withColumn("_nohost", no_host)
    d = d.withColumn("_tail", F.when(F.col("_nohost"), body).otherwise(F.substring(body, F.length(first) + 2, F.length(body))))
    tail = F.col("_tail")
    d = d.withColumn("_head", F.when(F.col("_split"), F.regexp_extract(tail, to_java(TAG_HEAD).text, 0)).otherwise(""))
    head = F.col("_head")
    d = d.withColumn("_tagged", head != "")
    dash = lambda c: F.when(c == "-", "").otherwise(c)
    five = k == "rfc5424"
    host = F.when(five, dash(_get(rest, r5424, "host"))).when(F.col("_split") & ~F.col("_nohost"), first).otherwise("")
    process = F.when(five, dash(_get(rest, r5424, "app"))).when(F.col("_tagged"), F.substring_index(F.substring_index(head, ":", 1), "[", 1)).otherwise("")
    pid = F.when(five, _get(rest, r5424, "procid")).when(head.contains("["), F.substring_index(F.substring_index(head, "]", 1), "[", -1)).otherwise("")
    message = F.when(five, _get(rest, r5424, "msg")).when(F.col("_tagged"), F.substring(tail, F.length(head) + 1, F.length(tail))).when(F.col("_split"), tail).otherwise(body)
    good = F.col("_n") <= 191
    # columns of their own: fields of a struct would be inlined into every use
    env = {
        "format": k,
        "facility": F.coalesce(F.when(good, F.element_at(F.array(*[F.lit(x) for x in FACILITIES]), F.floor(F.col("_n") / 8).cast("int") + 1)), F.lit("")),
        "level": F.coalesce(F.when(good, F.col("_n") % 8), F.lit(-1)),
        "time": F.when(k == "rfc3164", bsd_time(F.col("_ts"), now, zone)).otherwise(iso_time(F.col("_ts"))),
        "host": host, "process": process, "pid": F.coalesce(F.when(F.col("_pid").rlike(r"\A[+-]?\d+\z"), F.col("_pid").try_cast("int")), F.lit(0)), "message": message,
    }
    d = d.withColumn("_pid", pid)
    return d.withColumns({f"env_{name}": c for name, c in env.items()}).drop("_pri", "_rest", "_n", "_five", "_iso", "_bsd", "_kind", "_ts", "_body", "_split", "_nohost", "_tail", "_head", "_tagged", "_pid")
