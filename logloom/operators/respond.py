"""Decisions about blocking an address, as columns. Nothing here runs a firewall."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.checkpoint import cut
from logloom.functions import ip

AUDIT = "at timestamp, source_ip string, score int, rule string, allowed boolean, reason string"

# The order of the checks and their words, the least score, the blocks an hour, the most of one run.
MIN_SCORE, PER_HOUR, PER_RUN = 90, 20, 5
INVALID, DISABLED, ALLOWED, NO_HOST, LOW, RATE = "invalid IP address", "active response is disabled", "target is allowlisted", "target is not a unicast host address", "score below threshold", "rate limit reached"


def in_networks(address: Column, networks: list[str]) -> Column:
    """Whether an IPv4 or IPv6 address is in one of the networks (CIDR); malformed entries count for nothing."""
    v4, v6 = [], []
    for n in networks:
        try:
            net = ipaddress.ip_network(n.strip(), strict=False)
        except ValueError:
            continue
        (v4 if net.version == 4 else v6).append(net)
    p = F.split(address, r"\.")
    number = sum((F.try_element_at(p, F.lit(i + 1)).try_cast("bigint") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0).cast("bigint"))
    out = F.lit(False)
    for net in v4:
        out = out | (ip.is_v4(address) & number.between(int(net[0]), int(net[-1])))
    if v6:
        @F.udf("boolean", useArrow=True)
        def inside(a):
            try:
                x = ipaddress.ip_address(a)
            except ValueError:
                return False
            return any(x in n for n in v6 if n.version == x.version)

        out = out | F.when(address.contains(":"), inside(address)).otherwise(False)
    return F.coalesce(out, F.lit(False))


def decide(candidates: DataFrame, mode: str = "dry-run", allowlist: list[str] = (), min_score: int = MIN_SCORE, recent: int = 0, per_hour: int = PER_HOUR, address: str = "source_ip", order: str = "seq") -> DataFrame:
    """Adds ``allowed, reason``: the first check that fails, or the candidate's own reason.

    In enforce mode the hour's ``per_hour`` blocks, ``recent`` of which are spent, go to the
    first candidates that pass all other checks; the candidates are written once, with the
    columns that they have, so that what makes them doesn't run again for the ranking.
    """
    a = F.col(address)
    scope = ip.scope(a)
    why = (F.when(~ip.is_ip(a), INVALID).when(F.lit(mode == "disabled"), DISABLED).when(in_networks(a, list(allowlist)), ALLOWED)
           .when(scope.isin("multicast", "unspecified") | a.rlike(r"\A(?:22[4-9]|23[0-9])\.") | F.lower(a).startswith("ff"), NO_HOST).when(F.col("score") < min_score, LOW))
    d = candidates.withColumn("_why", why)
    if mode == "enforce":
        d = cut(d)
        # only what passed is ranked; a top-k of the hour's blocks, not a sort of all
        passed = d.where("_why IS NULL").select(order).orderBy(order).limit(max(0, per_hour - recent)).withColumn("_in", F.lit(True))
        d = d.join(F.broadcast(passed), order, "left").withColumn("_why", F.when(F.col("_why").isNull() & F.col("_in").isNull(), RATE).otherwise(F.col("_why"))).drop("_in")
    return d.withColumn("allowed", F.col("_why").isNull()).withColumn("reason", F.coalesce("_why", F.col("rule"))).drop("_why")


def plan_run(decisions: DataFrame, done: DataFrame, prefixes: list[str] = (), min_score: int = MIN_SCORE, most: int = PER_RUN, address: str = "source_ip") -> DataFrame:
    """What one run of a host's responder would block: new addresses, checked again, at most ``most``."""
    d = decisions.where(F.col("allowed") & (F.col("score") >= min_score)).where(ip.is_ip(F.col(address)))
    for p in prefixes:
        d = d.where(~F.col(address).startswith(p))
    first = d.withColumn("_k", F.row_number().over(W.partitionBy(address).orderBy("seq"))).where("_k = 1").drop("_k")
    return first.join(done.select(address), address, "left_anti").orderBy("seq").limit(most)


def status(audit: DataFrame, now, hours: int = 1) -> DataFrame:
    """One row: blocks of the last hour, decisions and refusals."""
    recent = F.col("at") > F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(hours))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias
    return audit.agg(n(F.col("allowed") & recent)("blocks_last_hour"), F.count("*").alias("decisions"), n(~F.col("allowed"))("refused"))


def append(decisions: DataFrame, at: Column, path: str) -> None:
    """Adds every decision, refusals too, to the audit as lines of JSON; what stands there is never rewritten."""
    decisions.select(at.alias("at"), F.col("source_ip"), F.col("score").cast("int").alias("score"), "rule", "allowed", "reason").write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit's rows; lines that aren't JSON objects are skipped."""
    line = spark.read.text(path).withColumn("_v", F.try_parse_json("value")).where("_v IS NOT NULL AND startswith(schema_of_variant(_v), 'OBJECT')")
    return line.select(F.from_json("value", AUDIT).alias("r")).select("r.*")


def history(audit: DataFrame, n: int = 50) -> DataFrame:
    return audit.orderBy(F.col("at").desc()).limit(n)
