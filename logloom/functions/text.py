"""Neutralising hostile log text, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LINE = 8192
MARKER = "…[truncated]"
# Control sequences, invisible code points, control characters.
ANSI = r"\x1b(?:\[[\x20-\x3f]*+[\s\S]?|\][^\x07\x1b]*+(?:\x1b(?!\\)[^\x07\x1b]*+)*+(?:\x07|\x1b\\)?|[\s\S])?"
INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}\x{ad}]"
CONTROL = r"[\x00-\x1f\x7f-\x9f]"
#: What a line of printable ASCII doesn't hold; none of the steps changes such a line.
ODD = r"[^\x20-\x7e]"


def fingerprint(raw: Column) -> Column:
    return F.sha2(raw.cast("binary"), 256)


def cap(text: Column, most: int) -> Column:
    """At most ``most`` bytes: cut on a character boundary, with a marker in the place of what is lost."""
    cut = max(0, most - len(MARKER.encode()))
    raw = text.cast("binary")

    def starts(at: int) -> Column:
        b = F.conv(F.hex(F.substring(raw, at + 1, 1)), 16, 10).cast("int")
        return ~b.between(0x80, 0xBF)

    keep = F.when(starts(cut), cut)
    for back in (1, 2):
        keep = keep.when(starts(max(0, cut - back)), max(0, cut - back))
    kept = F.substring(raw, F.lit(1), keep.otherwise(max(0, cut - 3))).cast("string")
    return F.when(F.octet_length(text) > most, F.concat(kept, F.lit(MARKER))).otherwise(text)


def field(value: Column, most: int = 256) -> Column:
    """A short extracted value: capped and trimmed."""
    return F.trim(cap(value, most))


def _escaped(text: Column) -> Column:
    one = lambda c: F.when(c == "\t", " ").when(c.rlike(CONTROL), F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(c))), 2, "0"))).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def sanitise(df, raw: str = "raw", most: int = MAX_LINE):
    """Adds ``clean`` and ``san_``: modified, truncated, control, escape, bidi, invalid_utf8."""
    r = F.col(raw)
    plain = F.col("_plain")
    unless_plain = lambda c: F.when(plain, False).otherwise(c)
    d = df.withColumn("_plain", ~r.rlike(ODD))
    d = d.withColumn("_ok", F.when(plain, True).otherwise(F.is_valid_utf8(r)))
    d = d.withColumn("_v", F.when(F.col("_ok"), r).otherwise(F.regexp_replace(F.make_valid_utf8(r), r"\x{FFFD}+", "\ufffd")))
    d = d.withColumn("_esc", unless_plain(F.col("_v").contains("\x1b")))
    d = d.withColumn("_e", F.when(F.col("_esc"), F.regexp_replace("_v", ANSI, "")).otherwise(F.col("_v")))
    d = d.withColumn("_bidi", unless_plain(F.col("_e").rlike(INVISIBLE)))
    d = d.withColumn("_b", F.when(F.col("_bidi"), F.regexp_replace("_e", INVISIBLE, "")).otherwise(F.col("_e")))
    d = d.withColumn("_ctl", unless_plain(F.col("_b").rlike(CONTROL)))
    d = d.withColumn("_c", F.when(F.col("_ctl"), _escaped(F.col("_b"))).otherwise(F.col("_b")))
    long = F.octet_length("_c") > most
    d = d.withColumn("clean", cap(F.col("_c"), most))
    return d.select(
        *df.columns, "clean", (~F.col("_ok") | (F.col("clean") != r)).alias("san_modified"), long.alias("san_truncated"), F.col("_ctl").alias("san_control"),
        F.col("_esc").alias("san_escape"), F.col("_bidi").alias("san_bidi"), (~F.col("_ok")).alias("san_invalid_utf8"),
    )
