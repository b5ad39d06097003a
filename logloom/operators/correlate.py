"""Brute force and compromise by source: one pure step, driven by batches or by a stream.

State is per source address and inherently sequential (cooldown, reset), so the batch
form walks partitions sorted by source and sequence number. Only events that can change
state are shuffled: failures and successes with an address, five columns. A source that
holds a third of all rows is still one sequence: Spark's sort spills and the walk takes
Arrow batches with the state of one window, so it is long, not large.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import timedelta
from heapq import heapify, heappop, heappush, nsmallest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.checkpoint import cut
from logloom.functions import ip
from logloom.sources.schema import CORRELATOR, complete, is_incident, severity_for

# Defaults, scores and texts of incidents.
THRESHOLD, WINDOW_S, COOLDOWN_S, LISTED = 5, 60, 300, 10
BRUTE, PUBLIC, SPRAY, SPRAY_USERS, COMPROMISE = 82, 6, 4, 3, 97
BRUTE_RULE, COMPROMISE_RULE = "correlated_brute_force", "correlated_successful_login_after_bruteforce"
BRUTE_MITRE, COMPROMISE_MITRE = ("T1110.001", "T1110.003"), ("T1110.001", "T1078.003")
SPRAY_TAGS = ("password-spraying", "パスワードスプレー")
BRUTE_TAGS = ("brute-force", "ブルートフォース", "incident", "インシデント", "correlated", "相関検知", "authentication")
COMPROMISE_TAGS = ("account-compromise", "アカウント侵害", "incident", "インシデント", "correlated", "相関検知", "brute-force", "ブルートフォース", "authentication")


@dataclass
class Config:
    threshold: int = THRESHOLD
    window_s: int = WINDOW_S
    cooldown_s: int = COOLDOWN_S

    @property
    def reached(self) -> int:
        """Failures before a success that make it a compromise."""
        return self.threshold // 2 + 1


@dataclass
class State:
    failures: list = field(default_factory=list)  # a heap of times in microseconds
    users: set = field(default_factory=set)
    alerted: int | None = None
    total: int = 0

    def __post_init__(self):
        heapify(self.failures)
        self.first = nsmallest(LISTED, self.users)  # by name, kept in order

    def add(self, user: str) -> None:
        if user not in self.users:
            self.users.add(user)
            if len(self.first) < LISTED or user < self.first[-1]:
                insort(self.first, user)
                del self.first[LISTED:]

    def listed(self) -> str:
        return ", ".join(self.first + ([f"+{len(self.users) - LISTED} more"] if len(self.users) > LISTED else []))


def step(s: State, at: int, failure: bool, user: str, cfg: Config) -> tuple | None:
    """(kind, failures in the window, users, distinct users, failures ever) of the incident that this event makes, if any."""
    # whatever the order of times, only the oldest leave: no failure is looked at again while it stays
    while s.failures and s.failures[0] <= at - cfg.window_s * 1_000_000:
        heappop(s.failures)
    if failure:
        s.total += 1
        if user:
            s.add(user)
        # the event itself counts as soon as the window has a length
        if cfg.window_s > 0:
            heappush(s.failures, at)
        if len(s.failures) >= cfg.threshold and (s.alerted is None or at - s.alerted >= cfg.cooldown_s * 1_000_000):
            s.alerted = at
            return "brute", len(s.failures), s.listed(), len(s.users), s.total
        return None
    recent = len(s.failures)
    if recent >= cfg.reached:
        s.failures = []
        return "compromise", recent, s.listed(), len(s.users), s.total
    return None


def failure() -> Column:
    return (F.col("outcome") == "failure") & F.col("category").isin("authentication", "privilege-escalation")


def success() -> Column:
    return (F.col("outcome") == "success") & (F.col("category") == "authentication")


def changes() -> Column:
    """Whether an event can change the state of its source."""
    return (F.col("source_ip") != "") & (failure() | success()) & F.col("timestamp").isNotNull()


def duration(seconds: int) -> str:
    """As 1h2m3s, where leading zero parts are left out."""
    h, m, s = seconds // 3600, seconds // 60 % 60, seconds % 60
    return (f"{h}h" if h else "") + (f"{m}m" if h or m else "") + f"{s}s"


#: What an incident takes from its trigger.
CARRIED = ("seq", "raw_sha256", "ingested_at", "timestamp", "host", "facility", "source_ip", "source_port", "user", "rule")
FOUND = "seq long, kind string, failures int, users string, n_users int, total int"


def scan(cfg: Config):
    """mapInPandas function over rows sorted by source and seq: one source's state at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, s = None, State()
        for b in batches:
            rows = []
            for ip_, seq, at, fail, user in zip(b["source_ip"], b["seq"], b["at"], b["fail"], b["user"]):
                if ip_ != source:
                    source, s = ip_, State()
                hit = step(s, int(at), bool(fail), user or "", cfg)
                if hit:
                    rows.append((seq, *hit))
            yield pd.DataFrame(rows, columns=["seq", "kind", "failures", "users", "n_users", "total"])

    return run


def triggers(events: DataFrame, cfg: Config | None = None) -> DataFrame:
    """One row for each incident: the sequence number of its event and what the window held."""
    cfg = cfg or Config()
    small = events.where(changes())
    return _walk(small.select("source_ip", "seq", F.unix_micros("timestamp").alias("at"), failure().alias("fail"), "user"), cfg)


def _walk(small: DataFrame, cfg: Config) -> DataFrame:
    # sources without enough failures can't raise anything: they end at a map-side combined count
    enough = small.where("fail").groupBy("source_ip").agg(F.count("*").alias("n")).where(F.col("n") >= min(cfg.threshold, cfg.reached)).select("source_ip")
    small = small.join(enough, "source_ip", "left_semi")
    return small.repartition("source_ip").sortWithinPartitions("source_ip", "seq").mapInPandas(scan(cfg), FOUND)


def incidents(events: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Synthetic events, one for each trigger, numbered in the order of their sequence numbers."""
    cfg = cfg or Config()
    # what can change state is written once: the counts, the walk and the triggers' columns come from it
    small = cut(events.where(changes()).select(*CARRIED, F.unix_micros("timestamp").alias("at"), failure().alias("fail")))
    found = _walk(small.select("source_ip", "seq", "at", "fail", "user"), cfg)
    return build(small.drop("at", "fail").join(found, "seq"), cfg)


def build(hits: DataFrame, cfg: Config) -> DataFrame:
    """Incidents from trigger events joined with their findings."""
    # incidents are few by construction (a cooldown each): one window numbers them
    d = hits.withColumn("_n", F.row_number().over(W.orderBy("seq"))).withColumn("_scope", ip.scope(F.col("source_ip"))).withColumn("_brute", F.col("kind") == "brute")
    brute = F.col("_brute")
    who = F.when(F.col("users") == "", "none recorded").otherwise(F.col("users"))
    text = F.when(brute, F.format_string(f"INCIDENT brute-force: %d authentication failures from %s within {duration(cfg.window_s)} (targeted users: %s)", "failures", "source_ip", who)).otherwise(
        F.format_string('INCIDENT probable compromise: successful login for "%s" from %s after %d recent failures from the same source', F.replace(F.replace("user", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), "source_ip", "failures"))
    spray = F.col("n_users") >= SPRAY_USERS
    score = F.when(brute, BRUTE + F.when(F.col("_scope") == "public", PUBLIC).otherwise(0) + F.when(spray, SPRAY).otherwise(0)).otherwise(COMPROMISE)
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    pairs = [("trigger_rule", F.col("rule")), ("trigger_sha256", F.col("raw_sha256")), ("source_scope", F.col("_scope")), ("targeted_users", F.col("users")),
             ("failure_count", F.when(brute, F.col("failures").cast("string"))), ("window", F.when(brute, F.lit(duration(cfg.window_s)))),
             ("total_failures_seen", F.when(brute, F.col("total").cast("string"))), ("preceding_failures", F.when(~brute, F.col("failures").cast("string")))]
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(v, F.lit("")).alias("v")) for k, v in pairs])
    d = d.withColumn("_text", text).withColumn("_score", score)
    out = d.select(
        "seq", F.sha2(F.concat(F.lit("incident:"), F.col("_n").cast("string"), F.lit(":"), "source_ip", F.lit(":"), "_text"), 256).alias("raw_sha256"), "ingested_at", "timestamp", "host", "facility",
        F.lit(CORRELATOR).alias("process"), F.col("_text").alias("message"), F.lit("authentication").alias("category"), severity_for(F.col("_score")).alias("severity"), F.col("_score").alias("score"),
        F.when(brute, BRUTE_RULE).otherwise(COMPROMISE_RULE).alias("rule"), F.when(brute, "attempt").otherwise("success").alias("outcome"),
        F.when(brute, lits(BRUTE_MITRE)).otherwise(lits(COMPROMISE_MITRE)).alias("mitre"),
        F.when(brute & spray, lits(SPRAY_TAGS + BRUTE_TAGS)).when(brute, lits(BRUTE_TAGS)).otherwise(lits(COMPROMISE_TAGS)).alias("tags"),
        "source_ip", "source_port", "user", F.map_from_entries(F.filter(entries, lambda p: p["v"] != "")).alias("fields"), F.lit(True).alias("parse_ok"))
    return complete(out)


def at_least(events: DataFrame, score: int) -> DataFrame:
    """The score filter, which incidents always pass."""
    return events.where((F.col("score") >= score) | is_incident())


def sliding_failures(events: DataFrame, key: str = "source_ip", time: str = "timestamp", window_s: int = WINDOW_S, cond: Column | None = None) -> DataFrame:
    """Events with ``n_failures``: failures of the key within the window that ends at the event, its lower bound excluded. Native."""
    cond = failure() if cond is None else cond
    span = window_s * 1_000_000
    at = F.unix_micros(F.col(time).cast("timestamp"))
    d = events.withColumns({"_at": at, "_fail": F.when(cond, 1).otherwise(0)})
    # a failure counts from its time on and comes once more when it expires, a window later: a
    # running sum within windows of fixed bounds, which hold all that a row of theirs can see
    end = F.when((F.col("_fail") == 1) & F.col("_at").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d = d.withColumn("_end", F.explode(end)).withColumn("_at", F.col("_at") + F.col("_end") * F.lit(span))
    d = d.withColumn("_slice", F.col("_at") - F.pmod("_at", F.lit(span)))
    part = W.partitionBy(key, "_slice")
    change = F.when(F.col("_end") == 1, -1).otherwise(F.col("_fail"))
    n = F.sum(change).over(part.orderBy("_at").rangeBetween(W.unboundedPreceding, 0)) + F.sum("_end").over(part)
    return d.withColumn("n_failures", n.cast("bigint")).where("_end = 0").drop("_at", "_fail", "_end", "_slice")


