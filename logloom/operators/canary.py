"""Canaries: decoy users, paths, hosts and processes whose mention is an alarm."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lists of a configuration, the kinds they hold, the shortest text that is searched for.
LISTS = {"users": "user", "paths": "path", "hosts": "host", "processes": "process"}
SHORTEST = 4


@dataclass(frozen=True)
class Token:
    value: str
    kind: str
    note: str = ""


@dataclass
class Canaries:
    tokens: list[Token] = field(default_factory=list)

    @classmethod
    def of(cls, config: dict) -> Canaries:
        """From lists of names or of {value, note}; what is unknown, empty, doubled or too short is refused."""
        odd = set(config) - set(LISTS)
        if odd:
            raise ValueError(f"unknown canary lists: {sorted(odd)}")
        out, users = [], set()
        for name, kind in LISTS.items():
            for entry in config.get(name) or []:
                if isinstance(entry, str):
                    entry = {"value": entry}
                if not isinstance(entry, dict) or set(entry) - {"value", "note"}:
                    raise ValueError(f"a {kind} canary is a text or has value and note: {entry!r}")
                value = str(entry.get("value") or "").strip()
                if not value:
                    raise ValueError(f"empty {kind} canary")
                if kind == "user":
                    if value.lower() in users:
                        raise ValueError(f"duplicate user canary {value!r}")
                    users.add(value.lower())
                elif len(value.encode()) < SHORTEST:
                    raise ValueError(f"{kind} canary {value!r} is shorter than {SHORTEST} bytes")
                out.append(Token(value, kind, str(entry.get("note") or "")))
        return cls(sorted(out, key=lambda t: (t.kind, t.value)))

    @classmethod
    def load(cls, text: str) -> Canaries:
        return cls.of(json.loads(text))

    def counts(self) -> dict[str, int]:
        return {k: n for k in LISTS.values() if (n := sum(t.kind == k for t in self.tokens))}

    def hits(self, user: Column, target: Column, message: Column) -> Column:
        """``array<struct<value, kind, note, field>>``, by kind and value: identities are compared whole, all else is searched for in the message."""
        low = F.lower(message)
        each = []
        for t in self.tokens:
            name = t.value.lower()
            entry = lambda where, t=t: F.struct(F.lit(t.value).alias("value"), F.lit(t.kind).alias("kind"), F.lit(t.note).alias("note"), F.lit(where).alias("field"))
            if t.kind == "user":
                as_user, as_target = F.lower(user) == name, F.lower(target) == name
                each += [F.when(as_user, entry("user")), F.when(as_target, entry("target_user")), F.when(low.contains(name) & ~as_user & ~as_target, entry("message"))]
            else:
                each.append(F.when(low.contains(name), entry("message")))
        kind = "array<struct<value:string,kind:string,note:string,field:string>>"
        return F.filter(F.array(*each).cast(kind), lambda x: x.isNotNull()) if each else F.array().cast(kind)


def collisions(canaries: Canaries, accounts: DataFrame, name_col: str = "name") -> DataFrame:
    """Decoy users that are real accounts: ``value``, sorted."""
    spark = accounts.sparkSession
    users = [(t.value, t.value.lower()) for t in canaries.tokens if t.kind == "user"]
    decoys = spark.createDataFrame(users, "value string, low string")
    real = accounts.select(F.lower(F.trim(name_col)).alias("low"))
    return decoys.join(real, "low", "left_semi").select("value").orderBy("value")


def passwd_accounts(lines: DataFrame, col: str = "value") -> DataFrame:
    """Account names of passwd-like lines."""
    return lines.where(F.col(col).contains(":") & ~F.col(col).startswith("#")).select(F.substring_index(col, ":", 1).alias("name"))
