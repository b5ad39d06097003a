"""Address validity and scope as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_H = r"[0-9a-fA-F]{1,4}"


def _v6() -> str:
    """Every placement of ``::`` among at most eight groups, the last two of which may be dotted."""
    low = rf"(?:{_H}:{_H}|{V4})"
    forms = [rf"(?:{_H}:){{6}}{low}"]
    for before in range(8):
        lead = rf"(?:{_H}(?::{_H}){{0,{before - 1}}})?" if before else ""
        after = 7 - before  # groups that may follow
        tails = [rf"(?:{_H}(?::{_H}){{0,{after - 1}}})?"] if after else [""]
        if after >= 2:
            tails.append(rf"(?:{_H}:){{0,{after - 2}}}{V4}")
        forms += [rf"{lead}::{t}" for t in tails]
    return "(?:" + "|".join(forms) + ")"


V6 = _v6()
#: Fixed patterns: how an address is looked for in free text.
FIND_V4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
FIND_V6 = r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b"


def is_v4(c: Column) -> Column:
    return c.rlike(rf"\A{V4}\z")


def is_ip(c: Column) -> Column:
    return is_v4(c) | (c.contains(":") & c.rlike(rf"\A{V6}\z"))


def first_ip(text: Column) -> Column:
    """The first IPv4-looking token if it is an address, else the first IPv6-looking one, else ''."""
    from logloom.functions.regex import to_java

    a = F.regexp_extract(text, to_java(FIND_V4).text, 0)
    b = F.regexp_extract(text, to_java(FIND_V6).text, 0)
    return F.when(text.contains(".") & is_v4(a), a).when(text.contains(":") & (F.length(b) > 0) & is_ip(b), b).otherwise(F.lit(""))


def scope(c: Column) -> Column:
    """loopback, link-local, private, unspecified, multicast, public, or unknown."""
    mapped = F.regexp_extract(F.lower(c), rf"\A(?:(?:0{{1,4}}:){{5}}|(?:0{{1,4}}(?::0{{1,4}}){{0,3}})?::)ffff:({V4})\z", 1)

    def v4(a: Column) -> Column:
        # octets have no leading zeros, so that prefixes tell them apart
        return (
            F.when(a.startswith("127."), "loopback")
            .when(a.startswith("169.254.") | a.startswith("224.0.0."), "link-local")
            .when(a.startswith("10.") | a.startswith("192.168.") | (a.startswith("172.") & a.rlike(r"\A172\.(?:1[6-9]|2[0-9]|3[01])\.")), "private")
            .when(a == "0.0.0.0", "unspecified")
            .when(a.startswith("2") & a.rlike(r"\A2(?:2[4-9]|3[0-9])\."), "multicast")
            .otherwise("public")
        )

    head = F.conv(F.regexp_extract(c, r"\A([0-9a-fA-F]{1,4}):", 1), 16, 10).try_cast("int")
    v6 = (
        F.when(c.rlike(r"\A[0:]*:0{0,3}1\z"), "loopback")
        .when(head.between(0xFE80, 0xFEBF) | head.bitwiseAND(0xFF0F).eqNullSafe(0xFF02), "link-local")
        .when(head.between(0xFC00, 0xFDFF), "private")
        .when(c.rlike(r"\A[0:]+\z"), "unspecified")
        .when(head >= 0xFF00, "multicast")
        .otherwise("public")
    )
    return F.when(is_v4(c), v4(c)).when(c.contains(":"), F.when(mapped != "", v4(mapped)).when(is_ip(c), v6).otherwise("unknown")).otherwise(F.lit("unknown"))
