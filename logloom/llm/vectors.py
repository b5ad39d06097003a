"""Near-duplicate embeddings by collision-counting projections.

Vectors are compared within their label only. Each is normalised and projected on
``projections`` Gaussian directions; along a direction the difference of a pair at
cosine c is normal with deviation sqrt(2-2c). For each query vector a window of
``reach`` such deviations (at the threshold) is centred on its value in the sorted
projection; a pair that shares at least ``need`` windows is verified by its cosine in
double precision. ``need`` is the largest count that a pair at the threshold reaches
with probability ``recall``.

A label is dealt to blocks of about ``block`` rows and every two blocks meet in one
bounded group, so a label with a third of all rows is as many groups as it needs; the
pairs within a label are quadratic by the contract (every link counts), while what is
shuffled or emitted is rows times blocks: a group returns counts and a spanning forest,
not pairs. Equal vectors of a label are one class with a number of copies.

Null, zero, null-holding or non-finite vectors and null labels link with nothing and
keep their own id as component; vectors of different lengths are never compared.
Repeated rows of an id count as vectors of their own. Extra columns are ignored.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.components import components
from logloom.llm.scratch import Scratch


def needed(projections: int, reach: float, recall: float) -> int:
    p = erf(reach / sqrt(2))
    tail, k = 0.0, 0
    while k < projections and tail + comb(projections, k) * p**k * (1 - p) ** (projections - k) <= 1 - recall:
        tail += comb(projections, k) * p**k * (1 - p) ** (projections - k)
        k += 1
    return k


def collisions(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """Windows shared by each pair: ``a`` and ``b`` are rows x projections."""
    count = np.zeros(len(a) * len(b), dtype=np.uint8)
    base = np.arange(len(a), dtype=np.int64) * len(b)
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k])
        v = b[order, k]
        lo, hi = np.searchsorted(v, a[:, k] - half), np.searchsorted(v, a[:, k] + half, side="right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        count[np.repeat(base, n) + order[at]] += 1  # a pair is met at most once in a projection
    return count.reshape(len(a), len(b))


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the pairs, of each of n rows."""
    c = np.arange(n)
    while len(x):
        m = np.minimum(c[x], c[y])
        new = c.copy()
        np.minimum.at(new, c[x], m)
        np.minimum.at(new, c[y], m)
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if (new == c).all():
            return c
        c = new
    return c


def _block(least: float, projections: int, reach: float, need: int, sub: int = 512):
    def run(table: pa.Table) -> pa.Table:
        ids, copies, home = (table.column(c).to_numpy() for c in ("id", "copies", "home"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x = np.array(table.column("v").to_pylist(), dtype=np.float64)
        o = np.lexsort((ids, home))
        ids, copies, home, x = ids[o], copies[o], home[o], x[o]
        # a power of two brings the largest component near one: squares neither overflow nor vanish, and no digit changes
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
        size = np.sqrt((x * x).sum(axis=1))
        d = x.shape[1]
        g = np.random.default_rng(1234 + d).standard_normal((d, projections))
        p = (x / size[:, None]) @ g
        half = reach * sqrt(2 - 2 * least) * (1 + 1e-9)
        left = np.flatnonzero(home == i)
        right = left if i == j else np.flatnonzero(home == j)
        xs, ys = [], []
        for s in range(0, len(left), sub):
            rows = left[s : s + sub]
            r, c = np.nonzero(collisions(p[rows], p[right], half) >= need)
            r, c = rows[r], right[c]
            if i == j:
                r, c = r[r < c], c[r < c]
            cos = np.concatenate([np.einsum("ij,ij->i", x[r[k : k + 65536]], x[c[k : k + 65536]]) for k in range(0, len(r), 65536)] or [np.zeros(0)]) / (size[r] * size[c])
            xs.append(r[cos >= least])
            ys.append(c[cos >= least])
        xs, ys = np.concatenate(xs or [np.zeros(0, int)]), np.concatenate(ys or [np.zeros(0, int)])
        links = np.bincount(xs, weights=copies[ys], minlength=len(ids)) + np.bincount(ys, weights=copies[xs], minlength=len(ids))
        root = _forest(len(ids), xs, ys)
        out = np.flatnonzero(links > 0)
        return pa.table({"id": ids[out], "links": links[out].astype(np.int64), "root": ids[root[out]]})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, projections: int = 24, reach: float = 1.5, recall: float = 1 - 1e-6, block: int = 512) -> DataFrame:
    """One row a vector: ``vec_id, n_links, component_id, kept``."""
    spark = vectors.sparkSession
    s = Scratch(spark, "vectors")
    need = needed(projections, reach, recall)
    v = F.col("v")
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    fit = F.col("label").isNotNull() & v.isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1.7e308)) & F.exists(v, lambda x: x != 0)
    plain = plain.withColumn("fit", F.coalesce(fit, F.lit(False)))
    rows = s.save("rows", plain.where("fit").select("vec_id", "label", F.size("v").alias("d"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), F.col("v")).alias("h2")))
    key = ["label", "d", "h1", "h2"]
    cls = s.save("cls", rows.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    # a class is a node of its own: one id may stand for several classes, by other vectors
    hashed = plain.where("fit").select(F.col("vec_id").alias("id"), "label", "v", F.size("v").alias("d"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), v).alias("h2"))
    reps = hashed.join(cls, ["id", *key]).dropDuplicates(["node"])
    reps = s.save("reps", reps.select(F.col("node").alias("id"), "label", "d", "v", "copies"))
    sizes = s.save("sizes", reps.groupBy("label", "d").agg(F.ceil(F.count("*") / block).cast("int").alias("nb")))
    # a row goes to the groups of its block with each block of the label; the few sizes ride on a join that skewed labels may split
    homed = reps.join(sizes, ["label", "d"]).withColumn("home", F.expr("cast(pmod(xxhash64(id, 11), nb) as int)"))
    dealt = homed.select("label", "d", "id", "copies", "v", "home", F.explode(F.expr("sequence(0, nb - 1)")).alias("other")).withColumn("i", F.least("home", "other")).withColumn("j", F.greatest("home", "other"))
    found = s.save("found", dealt.groupBy("label", "d", "i", "j").applyInArrow(_block(least, projections, reach, need), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.where("id <> root").select("id", "root"), s)
    tree = comp.select(F.col("node").alias("of"), "component")
    links = links.withColumnRenamed("id", "node")
    met = s.save("met", cls.join(links, "node", "left").join(tree, F.col("node") == F.col("of"), "left").select(*key, "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "node").alias("of")))
    named = s.save("named", met.join(met.groupBy("of").agg(F.min("id").alias("component_id")), "of").select(*key, "n_links", "component_id"))
    good = rows.join(named, key).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    other = plain.where("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return good.unionByName(other)
