"""Language identification by Bayesian evidence fusion.

log P(l | everything) = text likelihood + log P(declared | l) + log P(suffix | l) + log P(l | host)

* Text: naive Bayes over byte trigrams hashed to 2**16 buckets, fitted on the rows of at
  most ``TRAIN_ROWS`` ids of each label (those of the smallest hashes); a label with fewer
  than ``least`` rows in the whole table is not fitted. Applied to whole texts, with the
  mean likelihood weighted by at most ``EFFECTIVE`` trigrams, because trigrams of one text
  are not independent.
* Declared markup language and address suffix: how often each value goes with each
  language, by grouped sums of the text posteriors of all rows, smoothed.
* Host: the same sums by host, shrunk towards its domain, and that towards all rows, each
  level counting as ``SHRINK`` rows of the level below.
* ``unknown`` is a uniform distribution over the buckets with prior ``UNKNOWN``, so text
  that no fitted language explains better than chance is rejected.

The sums are map-side combined, so a host with a third of all rows is one row a task.
Evidence tables are broadcast up to ``BROADCAST_ROWS`` rows and joined in salted form
beyond. Null evidence says nothing. Texts without letters (null and empty too) are
``unknown`` and rejected. Null ids and repeated rows are rows like others; extra
columns are ignored; with no labelled rows every text is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm import kernels as K
from logloom.llm.scratch import Scratch, small_batches

BUCKETS = 1 << 16
TRAIN_ROWS = 6000
EFFECTIVE = 200
SHRINK = 20.0
SMOOTH = 2.0
UNKNOWN = 0.002
BROADCAST_ROWS = 100_000
SALTS = 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte, and the range of the trigrams of each row."""
    b = K.LOWER[buf].astype(np.uint32)
    x = np.zeros(len(b), dtype=np.uint32)
    if len(b) > 2:
        x[:-2] = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    x *= np.uint32(2654435761)
    return x >> np.uint32(16), off[:-1], np.maximum(off[1:] - 2, off[:-1])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to trigram counts by label."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        buf, off = K.texts(batch.column(1))
        labels = batch.column(0).to_pylist()
        x, lo, hi = _trigrams(buf, off)
        for i, name in enumerate(labels):
            total[name] = total.get(name, 0) + np.bincount(x[lo[i] : hi[i]], minlength=BUCKETS)
    for name, c in total.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["label", "bucket", "n"])


class Model:
    """Fitted languages and their log probabilities (languages x buckets)."""

    def __init__(self, names: list[str], logp: np.ndarray):
        self.names, self.logp = names, logp


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = TRAIN_ROWS, least: int = 3) -> Model:
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l")).where("i IS NOT NULL AND t IS NOT NULL AND l IS NOT NULL")
    d = d.withColumn("v", F.xxhash64("i"))
    # a hash prefix of each label holds its smallest hashes; sketches and sets are map-side combined
    sizes = d.groupBy("l").agg(F.count("*").alias("n"), F.approx_count_distinct("v").alias("ids")).where(F.col("n") >= least)
    part = sizes.select("l", (F.lit(2.0 * rows + 100) / F.col("ids")).alias("p"))
    small = d.select("l", "v").join(F.broadcast(part), "l").where("v / 18446744073709551616D + 0.5D < p").select("l", "v").distinct()
    ranked = small.withColumn("k", F.row_number().over(W.partitionBy("l").orderBy("v"))).where(F.col("k") <= rows)
    last = ranked.groupBy("l").agg(F.max("v").alias("last"))
    chosen = d.join(F.broadcast(last), "l").where("v <= last").select("l", "t")
    counts = chosen.mapInArrow(_counts, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("label").to_pylist()))
    table = np.full((len(names), BUCKETS), 0.5)
    at = {x: i for i, x in enumerate(names)}
    np.add.at(table, (np.array([at[x] for x in counts.column("label").to_pylist()], dtype=int), counts.column("bucket").to_numpy()), counts.column("n").to_numpy())
    return Model(names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def _score(shared):
    """mapInArrow on (row struct, text): log likelihoods of the languages and of unknown last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = shared.value
        for batch in batches:
            buf, off = K.texts(batch.column(1))
            out = np.zeros((len(batch), len(logp) + 1))
            for i, j in K.chunks(off):
                part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                x, lo, hi = _trigrams(part, o)
                n = (hi - lo).astype(float)
                weight = np.minimum(n, EFFECTIVE) / np.maximum(n, 1)
                sums = np.zeros(len(x) + 1)
                for k, table in enumerate(logp):
                    np.cumsum(table[x], out=sums[1:])
                    out[i:j, k] = (sums[hi] - sums[lo]) * weight
                out[i:j, -1] = -np.log(BUCKETS) * n * weight
                letters = np.zeros(len(part) + 1, dtype=np.int64)
                np.cumsum(_LETTER[part], out=letters[1:])
                out[i:j, -1][letters[o[1:]] == letters[o[:-1]]] = 1e6
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(2, batch.num_columns)], flat], names=[*batch.schema.names[2:], "ll"])

    return run


def _softmax(ll: str) -> F.Column:
    top = F.array_max(ll)
    e = F.transform(ll, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _attach(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of an evidence table whose size is checked; hot keys are salted where it isn't broadcast."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, "left")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.expr(f"cast(pmod(xxhash64(row), {SALTS}) as int)")).join(salted, [key, "salt"], "left").drop("salt")


def identify(rows: DataFrame, model: Model, id_cols: list[str], text: str = "text", declared: str | None = None, suffix: str | None = None, host: str | None = None, domain: str | None = None) -> DataFrame:
    """``id_cols, language, confidence, p_unknown, kept`` of each row."""
    spark = rows.sparkSession
    small_batches(spark)
    s = Scratch(spark, "langid")
    names, n = model.names, len(model.names)
    if not n:
        return rows.select(*id_cols, F.lit("unknown").alias("language"), F.lit(1.0).alias("confidence"), F.lit(1.0).alias("p_unknown"), F.lit(False).alias("kept"))
    evidence = {"declared": declared, "suffix": suffix, "domain": domain or host, "host": host}
    cols = [F.col(text).cast("string").alias("text"), F.struct(*id_cols).alias("row"), *[(F.lower(F.col(c).cast("string")) if c else F.lit(None).cast("string")).alias(k) for k, c in evidence.items()]]
    plain = rows.select(F.lit(0).alias("z"), *cols)
    schema = plain.drop("z", "text").schema
    shared = spark.sparkContext.broadcast(model.logp)
    scored = s.save("scored", plain.mapInArrow(_score(shared), schema.add("ll", T.ArrayType(T.DoubleType()))))
    priors = F.array(*[F.lit(float(np.log((1 - UNKNOWN) / n))) for _ in names], F.lit(float(np.log(UNKNOWN if n else 1.0))))
    post = scored.withColumn("w", F.zip_with("ll", priors, lambda a, b: a + b)).withColumn("q", _softmax("w"))
    zero = F.array(*[F.lit(0.0)] * (n + 1))

    def sums(key: str | None, extra: str | None = None) -> DataFrame:
        g = post.where(F.col(key).isNotNull()).groupBy(key, *([extra] if extra else [])) if key else post.groupBy()
        return g.agg(*[F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(n)]).select(*([key] if key else []), *([extra] if extra else []), F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(n)] or [F.lit(0.0)]).alias("c"))

    whole = (sums(None).first().c or [0.0] * n)[:n]
    total = [float(x) + 1.0 for x in whole]
    out = scored
    base = [x / sum(total) for x in total]
    for key in ("declared", "suffix"):
        if evidence[key]:
            # P(value | l) = (rows of l with it + smoothing) / rows of l; unknown takes the mean
            logs = F.array(*[F.ln((F.col("c")[i] + SMOOTH / 10) / F.lit(total[i] + SMOOTH)) for i in range(n)] or [F.lit(0.0)])
            mean = F.ln(F.aggregate(F.transform(logs, F.exp), F.lit(0.0), lambda a, x: a + x) / max(n, 1))
            table = sums(key).select(key, F.concat(F.slice(logs, 1, n), F.array(mean)).alias(f"e_{key}"))
            out = _attach(out, s.save(key, table), key)
    if host:
        size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        fine = s.save("hosts", sums("host", "domain"))
        shrunk = lambda parent: [(F.col("c")[i] + SHRINK * parent[i]) / (size("c") + SHRINK) for i in range(n)]
        coarse = s.save("domains", sums("domain").select("domain", F.array(*shrunk([F.lit(x) for x in base])).alias("pd")))
        table = fine.join(coarse, "domain").select("host", F.array(*[F.ln(x * (1 - UNKNOWN)) for x in shrunk(F.col("pd"))]).cast("array<double>").alias("e"))
        table = table.dropDuplicates(["host"])
        out = _attach(out, s.save("priors", table.select("host", F.concat("e", F.array(F.lit(float(np.log(UNKNOWN))))).alias("e_host"))), "host")
    else:
        out = out.withColumn("e_host", F.array(*[F.lit(float(np.log(x * (1 - UNKNOWN)))) for x in base], F.lit(float(np.log(UNKNOWN)))))
    terms = [c for c in out.columns if c.startswith("e_")]
    out = out.withColumn("e_host", F.coalesce("e_host", F.array(*[F.lit(float(np.log(x * (1 - UNKNOWN)))) for x in base], F.lit(float(np.log(UNKNOWN))))))
    w = F.col("ll")
    for t in terms:
        w = F.zip_with(w, F.coalesce(F.col(t), zero), lambda a, b: a + b)
    out = out.withColumn("w", w).withColumn("q", _softmax("w"))
    labels = F.array(*[F.lit(x) for x in [*names, "unknown"]])
    best = F.array_position("q", F.array_max("q")).cast("int")
    return out.select("row.*", F.element_at(labels, best).alias("language"), F.array_max("q").alias("confidence"), F.element_at("q", -1).alias("p_unknown"), (best <= n).alias("kept"))
