"""Linking the members of hash buckets exactly, without expanding a bucket into all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.components import components
from logloom.llm.scratch import Scratch

#: Members of a group that meet without a filter; results don't depend on it.
SMALL = 32


def shared(keyed: DataFrame) -> DataFrame:
    """``id, key, n`` of the rows ``id, key`` whose key occurs at least twice, ``n`` times.

    Keys are counted by a map-side combined aggregate and joined back, so the rows of a hot
    key are never gathered: the join's large partitions are split at run time.
    """
    n = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(n, "key")


def stars(keyed: DataFrame) -> DataFrame:
    """``p, id``: each member of a bucket beside the bucket's pivot, each pair once.

    The pivot is the member of the highest ``score``, the one that shares most keys with most
    others: of a text and its edited copies it is the text or a copy close to it, whatever the
    bucket, so a group of copies has few pivots and most members are linked with them at once.
    """
    best = keyed.groupBy("key").agg(F.max(F.struct("score", "id")).alias("m"), F.count("*").alias("n")).where("n > 1").select("key", F.col("m.id").alias("p"))
    return keyed.join(best, "key").where("p <> id").select("p", "id").distinct()


def _met(named: DataFrame, tokens: Callable[[DataFrame], DataFrame], sizes: DataFrame, s: Scratch, percent: int) -> DataFrame:
    """Pairs (x, y) of large groups in different components that may reach the threshold.

    A member of many groups comes once: groups that share members, or of which one's pivot is a member of the other,
    are one field ``g``, and the rows are the members times their elements, whatever the number of pivots.
    A prefix filter within the field, exact: in one order of its elements, rarest in the field
    first, two sets that share o elements share one among the first n - o + 1 of each. The
    threshold asks for ``o >= percent / (100 + percent) * (n + m)``, so the element at rank r of a set
    of n can be that one only for partners of at most ``most`` elements; a partner has no fewer than the field's smallest
    set, nor than ``percent`` hundredths of n. Edits of a copy's own
    are rare in its field: a copy with too many of them meets nobody, or the few that made the same
    edits, instead of the field. One side is never of the field's largest component.
    """
    fields = components(named.select("p", "id"), s, "ff").select(F.col("node").alias("id"), F.col("component").alias("g"))
    one = s.save("fields", named.select("id", "c").distinct().join(fields, "id").join(sizes, "id").select("id", "g", "c", "n"))
    s.sweep()
    rows = s.save("rows", tokens(one.select("id")).join(one, "id").select("g", "h", "id", "c", "n"))
    often = rows.groupBy("g", "h").agg(F.count("*").alias("k")).where("k > 1")
    mine = W.partitionBy("id")
    rank = F.row_number().over(mine.orderBy("k", "h")) + F.col("n") - F.count("*").over(mine)
    most = F.floor((F.col("n") - F.col("r") + 1) * (100 + percent) / percent + 1e-6) - F.col("n")
    index = rows.join(often, ["g", "h"]).withColumn("r", rank).withColumn("most", most).where(f"100 * most >= {percent} * n")
    # one row a field, as a table: a join with an aggregate of its own key couldn't split the rows of a large field
    least = one.groupBy("g").agg(F.min("n").alias("least"))
    largest = one.groupBy("g", "c").agg(F.count("*").alias("k")).groupBy("g").agg(F.max(F.struct("k", "c")).alias("m")).select("g", F.col("m.c").alias("main"))
    facts = s.save("facts", least.join(largest, "g"))
    index = s.save("index", index.join(facts.select("g", "least"), "g").where("most >= least").select("g", "h", "id", "c", "n", "most"))
    few = index.join(facts.select("g", "main"), "g").where("c <> main").select("g", "h", F.col("id").alias("q"), F.col("c").alias("qc"), F.col("n").alias("qn"), F.col("most").alias("qmost"))
    return index.join(few, ["g", "h"]).where("c <> qc AND n <= qmost AND qn <= most").select(F.least("q", "id").alias("x"), F.greatest("q", "id").alias("y")).distinct()


def link(star: DataFrame, distances: Callable[[DataFrame], DataFrame], tokens: Callable[[DataFrame], DataFrame], sizes: DataFrame, s: Scratch, percent: int) -> DataFrame:
    """``node, component`` of all that is linked, from the stars of the buckets.

    ``distances`` gives the sizes of the intersection and union of the sets of each pair (x, y) that may reach the threshold,
    ``tokens`` the elements ``id, h`` of the sets, ``sizes`` their number ``id, n``. After the stars, what
    shared a bucket shares a pivot. A pivot's group is done when its members are one
    component. In a group of at most ``SMALL``, members of different components meet
    (fewer than ``SMALL`` pairs a member); in larger ones, those that an exact filter admits. Then
    every pair that shared a bucket is in one component, tested, or proven to be below.
    """
    star = s.save("star", star)
    s.sweep()
    good = f"100 * both >= {percent} * either"
    first = s.save("t0", distances(star.select(F.least("p", "id").alias("x"), F.greatest("p", "id").alias("y")).distinct()))
    links = first.where(good).select("x", "y")
    comp = components(links, s, "cc0")
    s.sweep()
    named = star.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    named = s.save("members", named)
    # the groups with members of several components
    groups = named.groupBy("p").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("p", "k")
    groups = s.save("groups", groups)
    if groups.isEmpty():
        return comp
    sized = named.join(groups, "p")
    small, large = sized.where(f"k <= {SMALL}").drop("k"), s.save("large", sized.where(f"k > {SMALL}").drop("k"))
    other = small.select("p", F.col("id").alias("q"), F.col("c").alias("qc"))
    pairs = small.join(other, "p").where("id < q AND c <> qc").select(F.col("id").alias("x"), F.col("q").alias("y")).distinct()
    if not large.isEmpty():
        pairs = pairs.unionByName(_met(large, tokens, sizes, s, percent)).distinct()
    s.sweep()
    new = s.save("t1", distances(pairs.join(first.select("x", "y"), ["x", "y"], "left_anti"))).where(good).select("x", "y")
    s.drop("rows", "index")
    s.sweep()
    return comp if new.isEmpty() else components(links.unionByName(new), s, "cc1")
