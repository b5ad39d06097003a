"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``groups`` keys, each key the mix of ``rows`` minhashes, are
combined pairwise: ``groups**2`` table keys of ``2*rows`` minhashes each out of
``2*groups*rows`` minhashes. A pair of similarity s shares a table unless all keys
of one collection differ: it is missed with probability at most
``2*(1-s**rows)**groups`` (1e-3 at s = 0.8 with the defaults, 6e-5 at 0.85, 6e-7 at 0.9).

Candidates are verified on full shingle sets. Documents with equal sets are one
class (a hash aggregate) before any table is built, and a key that one class has alone enters no
pair of keys. A bucket's members are compared with its pivot, then only across components
and within exact bounds on the partner's size (see ``buckets.link``); no bucket is expanded into
all pairs, sampled or capped.

Edge cases: null text is empty; a text without words has no shingles, is linked with
nothing and kept; a null id takes its component from equal texts and is kept; repeated rows of one
id are one class, other texts of it classes of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm import kernels as K
from logloom.llm.buckets import link, shared, stars
from logloom.llm.scratch import Scratch, small_batches

SIGNED = np.int64
SIG = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("a", T.ArrayType(T.LongType())), T.StructField("b", T.ArrayType(T.LongType())), T.StructField("th", T.LongType())])


def _constants(groups: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    k = 2 * groups * rows
    return rng.integers(1, 1 << 63, k, dtype=np.uint64) | K.U(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def signatures(width: int, groups: int, rows: int):
    """mapInArrow function: size, 128-bit fingerprint and the two key collections of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _constants(groups, rows)
        top = np.iinfo(np.uint64).max
        for batch in batches:
            buf, off = K.texts(batch.column(1))
            for i, j in K.chunks(off):
                o = off[i : j + 1] - off[i]
                h, at = K.shingles(buf[off[i] : off[j]], o, width)
                n = j - i
                keys = np.zeros((2 * groups, n), dtype=K.U)
                for g in range(2 * groups):
                    acc = np.full(n, g + 1, dtype=K.U)
                    for r in range(rows):
                        x = h * mul[g * rows + r]
                        x += add[g * rows + r]
                        x ^= x >> K.U(32)
                        acc = K.mix(acc * K.U(0x9E3779B97F4A7C15) + K.segment_min(x, at, top))
                    keys[g] = acc
                flat = np.ascontiguousarray(keys.T).view(SIGNED)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, groups * n + 1, groups, dtype=np.int32)), pa.array(np.ascontiguousarray(x).reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(np.diff(at)), pa.array(K.segment_sum(K.mix(h), at).view(SIGNED)), pa.array(K.segment_sum(K.mix(h * K.U(K.BASE2)), at).view(SIGNED)), lists(flat[:, :groups]), lists(flat[:, groups:]), batch.column(2).slice(i, n)],
                    names=SIG.fieldNames(),
                )

    return run


def _verify(width: int):
    """mapInArrow function on (x, y, tx, ty): sizes of the intersection and the union of the two sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (2, 3):
                buf, off = K.texts(batch.column(c))
                # equal neighbours (a pivot beside each of its candidates) are shingled once
                sides.append([x for i, j in K.chunks(off) for x in _sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)])
            both = np.array([_common(a, b) for a, b in zip(*sides, strict=True)], dtype=np.int64)
            total = np.array([len(a) + len(b) for a, b in zip(*sides, strict=True)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both), pa.array(total - both)], names=["x", "y", "both", "either"])

    return run


def _elements(width: int):
    """mapInArrow function on (id, text): ``id, h``, one row for each element of the text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.texts(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in K.chunks(off):
                h, at = K.shingles(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i:j], np.diff(at))), pa.array(h.view(SIGNED))], names=["id", "h"])

    return run


def _tokens(ids: DataFrame, near: DataFrame, width: int) -> DataFrame:
    return near.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_elements(width), "id long, h long")


def _sets(buf: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    h, at = K.shingles(buf, off, width)
    return [h[at[i] : at[i + 1]] for i in range(len(at) - 1)]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, groups: int = 14, rows: int = 4) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept`` and ``text_hash``, the text's xxhash64, which tells rows of one id apart."""
    spark = docs.sparkSession
    small_batches(spark)
    s = Scratch(spark, "minhash")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    sig = s.save("sig", plain.mapInArrow(signatures(width, groups, rows), SIG))
    # a class is a node of its own: one id may stand for several classes, by other texts
    cls = sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.min_by("th", "doc_id").alias("th"))
    cls = s.save("cls", cls.withColumn("node", F.monotonically_increasing_id()))
    texts = cls.select(F.col("rep").alias("doc_id"), "th", "node")
    reps = sig.where("n > 0").join(texts, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select(F.col("node").alias("doc_id"), "a", "b")
    # of a class's keys only those that another class has go into the product of the two collections
    one = shared(reps.select(F.col("doc_id").alias("id"), F.posexplode(F.concat("a", "b")).alias("slot", "key")))
    one = one.groupBy("id").agg(F.sum("n").alias("score"), F.collect_list(F.when(F.col("slot") < groups, F.col("key"))).alias("a"), F.collect_list(F.when(F.col("slot") >= groups, F.col("key"))).alias("b"))
    one = s.save("shared", one)
    s.sweep()
    keyed = one.select("id", "score", F.explode("a").alias("ka"), "b").select("id", "score", "ka", F.explode("b").alias("kb")).select("id", "score", F.xxhash64("ka", "kb").alias("key"))
    star = s.save("stars", stars(keyed))
    s.sweep()
    ids = star.select("id").union(star.select("p")).distinct()
    near = texts.join(ids.select(F.col("id").alias("node")), "node", "left_semi")
    near = s.save("near", plain.join(near, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select(F.col("node").alias("doc_id"), "text"))
    s.sweep()
    comp = link(star, lambda pairs: _distances(pairs, near, width), lambda ids: _tokens(ids, near, width), cls.select(F.col("node").alias("id"), "n"), s, percent)
    both = s.save("both", cls.join(comp.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left").select("n", "h1", "h2", "rep", F.coalesce("component", "node").alias("of")))
    named = s.save("named", both.join(both.groupBy("of").agg(F.min("rep").alias("component")), "of").select("n", "h1", "h2", "component"))
    out = sig.join(named, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.col("th").alias("text_hash"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select("doc_id", "n_shingles", "component_id", "kept", "text_hash")


def _distances(pairs: DataFrame, plain: DataFrame, width: int) -> DataFrame:
    t = plain.where("doc_id IS NOT NULL")
    both = pairs.join(t.select(F.col("doc_id").alias("y"), F.col("text").alias("ty")), "y").join(t.select(F.col("doc_id").alias("x"), F.col("text").alias("tx")), "x")
    return both.select("x", "y", "tx", "ty").mapInArrow(_verify(width), "x long, y long, both long, either long").dropDuplicates(["x", "y"])
