"""Many probes: who may send, under which host name, and how much each has sent."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def authorised(rows: DataFrame, revoked: DataFrame | None = None, allowed: list[str] = (), name: str = "probe", fingerprint: str = "fingerprint") -> DataFrame:
    """Rows of named probes that are on the list (if there is one) and not revoked by name or fingerprint; ``revoked`` has ``value``."""
    d = rows.where(F.coalesce(name, F.lit("")) != "")
    d = d.where(F.col(name).isin(*allowed)) if allowed else d
    if revoked is not None:
        for c in (name, fingerprint):
            if c in rows.columns:
                d = d.join(revoked.select(F.col("value").alias(c)).where(F.col(c).isNotNull()), c, "left_anti")
    return d


class Revocations:
    """A deny list ``{"revoked": [{"name", "fingerprint"}]}`` in a file, read anew whenever rows are judged.

    Without the file nobody is revoked; from a malformed file nothing is taken, so that what was
    read last still holds and a broken write admits nobody.
    """

    def __init__(self, path: str):
        self.path = Path(path)
        self.names: frozenset[str] = frozenset()
        self.prints: frozenset[str] = frozenset()

    def read(self) -> None:
        listed: list[dict] = []
        try:
            found = json.loads(self.path.read_bytes())
        except OSError:
            found = {}
        except ValueError:
            return
        if isinstance(found, dict) and isinstance(found.get("revoked"), list):
            listed = [e for e in found["revoked"] if isinstance(e, dict)]
        self.names = frozenset(str(e["name"]) for e in listed if e.get("name"))
        self.prints = frozenset(re.sub("[: ]", "", str(e["fingerprint"])).lower() for e in listed if e.get("fingerprint"))

    def denies(self, name: str = "probe", fingerprint: str = "fingerprint") -> Column:
        """Whether a row's probe is revoked now, by its name or by its fingerprint however that is punctuated."""
        self.read()
        bare = F.lower(F.translate(F.coalesce(fingerprint, F.lit("")), ": ", ""))
        return F.coalesce(F.col(name).isin(*sorted(self.names)), F.lit(False)) | bare.isin(*sorted(self.prints))


def mismatch(probe: str = "probe") -> Column:
    return (F.coalesce("host", F.lit("")) != "") & (F.col("host") != F.col(probe))


def pin(rows: DataFrame, received_at: Column, probe: str = "probe", trust: bool = False, reject: bool = False) -> DataFrame:
    """Stamps ``_probe`` and ``_received_at``; the host is the probe's certified name, what it claimed goes to ``_claimed_host``."""
    odd = mismatch(probe)
    d = rows.where(~odd) if reject and not trust else rows
    d = d.withColumn("_claimed_host", F.when(F.lit(not trust) & odd, F.col("host"))).withColumn("_probe", F.col(probe)).withColumn("_received_at", received_at)
    return d if trust else d.withColumn("host", F.col(probe))


def stats(rows: DataFrame, probe: str = "probe", at: str = "_received_at", size: str = "bytes") -> DataFrame:
    """``probe, events, rejected, bytes, first_seen, last_seen``; ``accepted`` tells which rows count as events."""
    ok = F.col("accepted") if "accepted" in rows.columns else F.lit(True)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return rows.groupBy(probe).agg(n(ok).alias("events"), n(~ok).alias("rejected"), F.sum(size).cast("bigint").alias("bytes"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
