"""Connected components as a distributed union-find (minimum labels with pointer jumping)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """Smallest reachable node of every node that has an edge: ``node, component``.

    ``edges`` has two columns of one comparable type. Each round hooks every tree root
    on the smallest root that an edge of its tree sees (a map-side combined minimum, so a
    hub costs one row a task) and then halves the paths; the number of rounds grows with
    the logarithm of the longest path. State lives in shared tables; no native step
    leaves the JVM and the driver sees one count a round.
    """
    a, b = edges.columns[:2]
    e = scratch.save(f"{tag}-e", edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct())
    label = scratch.save(f"{tag}-0", e.select("v", "u").groupBy("v").agg(F.min("u").alias("c")).select(F.col("v").alias("node"), "c")
                         .unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("c"))).groupBy("node").agg(F.min("c").alias("c")))
    turn = 0
    while True:
        turn += 1
        lu = label.select(F.col("node").alias("u"), F.col("c").alias("cu"))
        lv = label.select(F.col("node").alias("v"), F.col("c").alias("cv"))
        seen = e.join(lu, "u").join(lv, "v").where("cu <> cv")
        hook = seen.select(F.greatest("cu", "cv").alias("root"), F.least("cu", "cv").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        hook = scratch.save(f"{tag}-h{turn}", hook)
        if hook.isEmpty():
            return label.select("node", F.col("c").alias("component"))
        moved = label.join(hook, label["c"] == hook["root"], "left").select("node", F.coalesce("to", "c").alias("c"))
        moved = scratch.save(f"{tag}-m{turn}", moved)
        up = moved.select(F.col("node").alias("p"), F.col("c").alias("pc"))
        new = moved.join(up, moved["c"] == up["p"], "left").select("node", F.least(F.col("c"), F.coalesce("pc", "c")).alias("c"))
        label = scratch.save(f"{tag}-{turn}", new)
        scratch.drop(f"{tag}-{turn - 1}", f"{tag}-m{turn}")
        if turn > 1:
            scratch.drop(f"{tag}-h{turn - 1}")
        scratch.sweep()
