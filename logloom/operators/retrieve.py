"""Vector search over chunks and parent-document retrieval with a floor for each language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions import vectors as V

# Sizes of the result and of the candidate pool, the floor, the context's length.
TOP_K, CANDIDATES, MAX_PARENTS, MIN_SIMILARITY, FLOOR, CONTEXT_CHARS = 8, 32, 5, 0.0, 2, 6000
LANGUAGES = ("en", "ja")
#: Similarities that a task has at once.
CELLS = 1 << 19
FIRST_CLASS = ("chunk_id", "parent_id", "lang", "ordinal")


def where(filters: dict | None, get=None) -> Column:
    """A filter document as a column: equality, $eq, $ne, $in, $nin, $and, $or; another operator is refused.

    A missing key equals nothing, so $ne and $nin hold for it.
    """
    get = get or (lambda k: F.col(k) if k in FIRST_CLASS else F.try_element_at("metadata", F.lit(k)))
    parts: list[Column] = []
    for key, cond in (filters or {}).items():
        if key in ("$and", "$or"):
            subs = [where(f, get) for f in cond]
            join = (lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b)
            parts.append(reduce(join, subs) if subs else F.lit(key == "$and"))
            continue
        c = get(key)
        text = lambda v: None if v is None else (v if key == "ordinal" else str(v))
        for op, v in (cond.items() if isinstance(cond, dict) else [("$eq", cond)]):
            if op in ("$eq", "$ne"):
                same = c.eqNullSafe(F.lit(text(v)))
                parts.append(same if op == "$eq" else ~same)
            elif op in ("$in", "$nin"):
                among = F.coalesce(c.isin([text(x) for x in v]), F.lit(False)) if v else F.lit(False)
                parts.append(among if op == "$in" else ~among)
            else:
                raise ValueError(f"unsupported filter operator {op!r}")
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def index(chunks: DataFrame, have: DataFrame | None = None, dim: int = V.DIM) -> DataFrame:
    """Chunks that are not indexed yet, with ``vector``; re-indexing what is unchanged embeds nothing."""
    new = chunks.dropDuplicates(["chunk_id"])
    if have is not None:
        new = new.join(have.select("chunk_id"), "chunk_id", "left_anti")
    return new.withColumn("vector", V.embedder(dim)("text"))


def upsert(store: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The store with the rows of ``rows`` in the place of those of the same key."""
    return store.join(rows.select(key), key, "left_anti").unionByName(rows)


def nearest(chunks: DataFrame, query: list[float], k: int, filters: dict | None = None) -> DataFrame:
    """The ``k`` most similar chunks under the filter, with ``score``; filter first, then a top-k without a full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return chunks.where(where(filters)).withColumn("score", V.cosine(F.col("vector"), q)).orderBy(F.col("score").desc(), "chunk_id").limit(k)


def nearest_each(queries: DataFrame, chunks: DataFrame, k: int, query_id: str = "query_id", chunk_id: str = "chunk_id", vector: str = "vector", block: int = 2048) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the same for a table of queries against all chunks, exactly.

    Queries go to the executors in blocks of ``block`` vectors, so what is sent is bounded; a
    task multiplies matrices of at most ``CELLS`` similarities and keeps its own k best of each
    query before the exchange, whatever the number of its rows.
    """
    spark = chunks.sparkSession
    d = queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).where("q IS NOT NULL AND size(v) > 0")
    kind = dict(chunks.dtypes)[chunk_id]
    rows = chunks.select(F.col(chunk_id).alias("c"), F.col(vector).cast("array<double>").alias("v")).where("size(v) > 0")
    parts = max(1, -(-d.count() // block))
    out = []
    for i in range(parts):
        mine = d.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == i).collect()
        if mine:
            shared = spark.sparkContext.broadcast(_by_size(mine))
            out.append(rows.mapInPandas(_best(shared, k), f"query_id long, chunk_id {kind}, score double"))
    if not out:
        return spark.createDataFrame([], f"query_id long, chunk_id {kind}, score double, rank int")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))
    return reduce(DataFrame.unionByName, out).withColumn("rank", rank).where(F.col("rank") <= k)


def _by_size(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and squared lengths of the queries, by the length of the vector."""
    out = {}
    for n in sorted({len(r.v) for r in rows}):
        mine = [r for r in rows if len(r.v) == n]
        m = np.array([r.v for r in mine], dtype=float)
        out[n] = (np.array([r.q for r in mine]), m, (m * m).sum(axis=1))
    return out


class _Top:
    """The k best of each query so far; of equals those of the least ids."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)  # a worse one can't come in any more
        self.q, self.c, self.s = np.zeros(0, dtype=np.int64), None, np.zeros(0)

    def add(self, s: np.ndarray, c: np.ndarray) -> None:
        """``s``: similarities, a row a query, to what has the ids ``c``."""
        q, j = np.nonzero(s >= self.least[:, None])
        if not len(q):
            return
        q, c, s = np.concatenate([self.q, q]), c[j] if self.c is None else np.concatenate([self.c, c[j]]), np.concatenate([self.s, s[q, j]])
        order = np.lexsort((c if c.dtype.kind in "iu" else np.unique(c, return_inverse=True)[1], -s, q))
        q, c, s = q[order], c[order], s[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        self.q, self.c, self.s = q[keep], c[keep], s[keep]
        full = rank == self.k - 1
        self.least[q[full]] = s[full]


def _best(shared, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = shared.value
        best = {n: _Top(len(q), k) for n, (q, _, _) in queries.items()}
        for b in batches:
            sizes = b["v"].map(len)
            for n, (q, m, mm) in queries.items():
                part = b[sizes == n]
                step = max(1, CELLS // len(q))
                for i in range(0, len(part), step):
                    x = np.array(part["v"].iloc[i : i + step].tolist(), dtype=float)
                    scale = np.sqrt(np.outer(mm, (x * x).sum(axis=1)))
                    best[n].add(np.divide(m @ x.T, scale, out=np.zeros(scale.shape), where=scale > 0), part["c"].iloc[i : i + step].to_numpy())
        for n, (q, _, _) in queries.items():
            if best[n].c is not None:
                yield pd.DataFrame({"query_id": q[best[n].q], "chunk_id": best[n].c, "score": best[n].s})

    return run


def top_up(pool: DataFrame, chunks: DataFrame, query: list[float], languages=LANGUAGES, floor: int = FLOOR, filters: dict | None = None) -> DataFrame:
    """The pool, and of each language that it lacks the best chunks that fill its floor. ``pool`` has at most a few dozen rows."""
    have = {r.lang: r.n for r in pool.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    extra = []
    for lang in languages:
        missing = floor - have.get(lang, 0)
        if missing > 0:
            more = nearest(chunks, query, missing * 3, {**(filters or {}), "lang": lang})
            extra.append(more.join(pool.select("chunk_id"), "chunk_id", "left_anti").orderBy(F.col("score").desc(), "chunk_id").limit(missing))
    return reduce(lambda a, b: a.unionByName(b), extra, pool)


def collapse(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Each parent once, by its best child; a parent that is lost is rebuilt from the child."""
    pid = F.when(F.coalesce("parent_id", F.lit("")) == "", F.col("chunk_id")).otherwise(F.col("parent_id"))
    order = F.struct(F.col("score"), F.xxhash64("chunk_id"))
    best = hits.withColumn("pid", pid).groupBy("pid").agg(F.max_by(F.struct("chunk_id", "text", "lang", "metadata", "score"), order).alias("b"))
    p = parents.select(F.col("doc_id").alias("pid"), F.col("title").alias("pt"), F.col("text").alias("px"), F.col("source").alias("ps"), F.col("lang").alias("pl"), F.col("doc_type").alias("pd"))
    meta = lambda k, other: F.coalesce(F.try_element_at("b.metadata", F.lit(k)), other)
    j = best.join(p, "pid", "left")
    return j.select(F.col("pid").alias("doc_id"), "b.chunk_id", "b.score", F.coalesce("pt", meta("title", F.col("pid"))).alias("title"), F.coalesce("px", "b.text").alias("text"), F.coalesce("ps", meta("source", F.lit(""))).alias("source"),
                    F.coalesce("pl", "b.lang").alias("lang"), F.coalesce("pd", meta("doc_type", F.lit("unknown"))).alias("doc_type"), F.col("px").isNull().alias("reconstructed"))


def with_floor(found: DataFrame, k: int = TOP_K, languages=LANGUAGES, floor: int = FLOOR, most: int = MAX_PARENTS) -> DataFrame:
    """At most ``k`` parents by score, each language's best reserved in turns before the rest is filled."""
    limit = min(k or TOP_K, most)
    place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang"))
    within = F.row_number().over(W.partitionBy("lang").orderBy(F.col("score").desc(), "doc_id"))
    d = found.withColumn("_r", within).withColumn("_p", place)
    reserved = (F.col("_p") > 0) & (F.col("_r") <= floor) if floor > 0 and len(languages) > 1 else F.lit(False)
    turn = F.when(reserved, F.col("_r")).otherwise(floor + 1)
    chosen = d.orderBy(turn, F.when(reserved, F.col("_p")).otherwise(0), F.col("score").desc(), "doc_id").limit(limit)
    return chosen.orderBy(F.col("score").desc(), "doc_id").drop("_r", "_p")


def retrieve(text: str, chunks: DataFrame, parents: DataFrame, k: int = TOP_K, filters: dict | None = None, languages=LANGUAGES, doc_types=None, min_similarity: float = MIN_SIMILARITY, embed=V.embed, dim: int = V.DIM) -> DataFrame:
    """Parents that answer ``text``; languages steer the floor, they don't filter."""
    if not text.strip():
        return collapse(chunks.withColumn("score", F.lit(0.0)).limit(0), parents)
    f = dict(filters or {}) | ({"doc_type": {"$in": list(doc_types)}} if doc_types else {})
    q = [float(x) for x in embed(text, dim)]
    pool = nearest(chunks, q, CANDIDATES, f)
    pool = top_up(pool, chunks, q, languages, FLOOR, f).where(F.col("score") >= min_similarity)
    return with_floor(collapse(pool, parents), k, languages)


def context(found: DataFrame, most: int = CONTEXT_CHARS) -> str:
    """Numbered source blocks of a result, up to ``most`` characters."""
    out, used = [], 0
    for i, r in enumerate(found.collect(), 1):
        block = f"[S{i}] {r.title} ({r.source}, {r.lang})\n{r.text}"
        if used + len(block) > most and out:
            break
        out.append(block[:most])
        used += len(block)
    return "\n\n".join(out)


def mix(found: DataFrame) -> DataFrame:
    return found.groupBy("lang", "doc_type").agg(F.count("*").alias("n"))
