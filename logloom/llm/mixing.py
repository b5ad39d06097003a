"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of ``total`` documents over its
own count. A document's number of copies is the Poisson distribution of that rate,
inverted at a uniform number hashed from seed and id, so it depends on no other row,
partition or retry. Documents are exploded by their copies and dealt by a second hash
of id and copy, on which each partition is then sorted: a global shuffle in one
exchange, reproducible, and a hot source spreads like any other.

Without weights the target is temperature sampling: share proportional to count**0.5.
A source without weight, or of weight 0, gets no copies. Null source: a source named
''. Null id: hashed as the word null. Repeated rows get equal numbers of copies. Empty
tables give empty results. Columns of the input are returned as they are, before
``copy`` and ``shuffle_key``, which replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.scratch import Scratch, partitions

#: Sources up to which the rates are broadcast (about 100 bytes a row).
BROADCAST_SOURCES = 50_000
SALTS = 64


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, total: float | None, temperature: float) -> DataFrame:
    """``src, rate, cdf``: the distribution up to where less than 1e-15 is left."""
    n = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src")).agg(F.count("*").alias("n"))
    if weights is None:
        w = n.withColumn("w", F.pow("n", F.lit(temperature)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(x)) for k, x in weights.items()], "src string, w double")
        w = n.join(given, "src", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    sums = w.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    whole, share = total if total is not None else sums.n or 0, sums.w or 0.0
    rate = w.select("src", (F.col("w") / F.lit(float(share) or 1.0) * F.lit(float(whole)) / F.col("n")).alias("rate"))
    # log p(k) = log p(k-1) + log rate - log k; each term of the sum is exp of it
    steps = F.expr("sequence(1, cast(ceil(rate + 12 * sqrt(rate) + 25) as int))")
    walk = F.aggregate(
        steps,
        F.struct((-F.col("rate")).alias("lp"), F.array(F.exp(-F.col("rate"))).alias("c")),
        lambda a, k: F.struct((a["lp"] + F.ln("rate") - F.ln(k.cast("double"))).alias("lp"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + F.exp(a["lp"] + F.ln("rate") - F.ln(k.cast("double"))))).alias("c")),
        lambda a: a["c"],
    )
    return rate.withColumn("cdf", F.when(F.col("rate") > 0, walk).otherwise(F.array(F.lit(2.0))))


def uniform(*parts) -> F.Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, id_col: str = "doc_id", source_col: str = "source", seed: int = 17, temperature: float = 0.5) -> DataFrame:
    spark = docs.sparkSession
    s = Scratch(spark, "mixing")
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rate = s.save("rates", rates(docs, source_col, weights, total, temperature))
    src = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*names).alias("row"), src.alias("src"), F.col(id_col).alias("key"))
    if rate.count() <= BROADCAST_SOURCES:
        met = rows.join(F.broadcast(rate), "src")
    else:
        salted = rate.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64(key), {SALTS}) as int)")).join(salted, ["src", "salt"])
    u = uniform(F.lit(seed), F.col("key"))
    copies = met.withColumn("u", u).withColumn("copies", F.size(F.filter("cdf", lambda c: c <= F.col("u"))))
    copies = copies.where("copies > 0").select("row", "key", F.explode(F.expr("sequence(1, copies)")).alias("copy"))
    text = F.concat_ws(":", F.lit(seed + 1), F.coalesce(F.col("key").cast("string"), F.lit("null")), F.col("copy"))
    keyed = copies.withColumn("shuffle_key", F.substring(F.md5(text), 1, 16))
    return keyed.repartition(partitions(spark), "shuffle_key").sortWithinPartitions("shuffle_key", "key", "copy").select("row.*", "copy", "shuffle_key")
