"""Licence scans with a trained paragraph classifier.

A paragraph is a run of neighbouring lines that look like a licence notice. Lines are
described by hashed word 1-, 2- and 3-grams. A binary logistic regression keeps lines that
may be part of a notice; a multinomial one over the licence families, ``unknown`` (a notice of
no known family) and ``none`` scores each paragraph by the sum of its lines' features. Its
temperature is fitted on held-out notices, and a family is predicted only if its
calibrated probability is ``sure`` or more; otherwise the paragraph is unknown. A prediction is confirmed
if the paragraph holds ``cover`` of the word 3-grams of one of the family's templates.

Training takes template notices in varied forms, made-up notices for unknown, and at most
``NEGATIVES`` lines of the table (the smallest hashes of all lines that name no licence)
for none; the scan covers every line of every text in one pass without a shuffle.

Null and empty texts have no paragraphs and status ``none``. Rows are independent: repeated
rows, null ids, ties and extra columns change nothing (ties between families go to the
first by name); an empty table gives an empty result, trained on built-in negatives.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import kernels as K
from logloom.llm.license_text import FAMILIES, ODD, PLAIN, UNKNOWN_FORMS
from logloom.llm.scratch import small_batches

BITS = 15
NEGATIVES = 3000
#: Log odds of none against any family before a word is read.
PRIOR = 3.0
HINT = r"(?i)licen[cs]e|copyright|rights reserved|permission|warrant|public domain|redistribut|spdx|proprietary|reproduced"
_NORMAL = np.full(256, 32, dtype=np.uint8)
_NORMAL[48:58] = np.arange(48, 58)
_NORMAL[97:123] = _NORMAL[65:91] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)


def lines_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the lines of the rows, and each line's row."""
    cut = np.union1d(off, np.flatnonzero(buf == 10) + 1)
    if not len(buf):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return cut, np.searchsorted(off, cut[:-1], side="right") - 1


def features(buf: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and line of every n-gram, and hash and line of the 3-grams."""
    low = _NORMAL[buf]
    start, end, row = K.words(low, lines)
    if not len(start):
        e = np.zeros(0, dtype=np.int64)
        return e, e, e.astype(K.U), e
    h = K.range_hash(K.prefix(low), start, end)
    two, three = h[:-1] * K.U(3) + h[1:] * K.U(7), h[:-2] * K.U(3) + h[1:-1] * K.U(7) + h[2:] * K.U(11)
    two, three = K.mix(two), K.mix(three)
    ok2, ok3 = row[1:] == row[:-1], row[2:] == row[:-2]
    x = np.concatenate([h, two[ok2], three[ok3]]) >> K.U(64 - BITS)
    return x.astype(np.int64), np.concatenate([row, row[:-1][ok2], row[:-2][ok3]]), three[ok3], row[:-2][ok3]


def _pack(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return K.texts(pa.array([t.replace("\n", " ").encode() for t in texts], pa.binary()))


class Classifier:
    """Weights of the gate and of the families, the temperature and the templates' 3-grams."""

    def __init__(self, names, gate, gate_bias, weights, bias, temperature, templates):
        self.names, self.gate, self.gate_bias, self.weights, self.bias, self.temperature, self.templates = names, gate, gate_bias, weights, bias, temperature, templates


def _descend(x, row, n, y, classes, none, rounds=150, rate=0.5, decay=1e-4):
    """Full-batch softmax regression with AdaGrad on n rows of hashed binary features.

    The intercepts are fixed, so a line without known n-grams is none: a notice needs evidence.
    """
    order = np.unique(row * (1 << BITS) + x)
    row, x = order >> BITS, order & ((1 << BITS) - 1)
    used, x = np.unique(x, return_inverse=True)
    at = np.searchsorted(row, np.arange(n + 1))
    w, b = np.zeros((len(used), classes)), np.zeros(classes)
    b[none] = PRIOR
    gw = np.full_like(w, 1e-6)
    weight = (1 / np.bincount(y, minlength=classes).clip(1))[y]
    weight /= weight.sum()
    hot = np.eye(classes)[y]
    for _ in range(rounds):
        z = np.stack([K.segment_sum(w[x, k], at) for k in range(classes)], axis=1) + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        e = (z / z.sum(axis=1, keepdims=True) - hot) * weight[:, None]
        g = np.stack([np.bincount(x, weights=e[row, k], minlength=len(used)) for k in range(classes)], axis=1) + decay * w / len(used)
        gw += g * g
        w -= rate * g / np.sqrt(gw)
    full = np.zeros((1 << BITS, classes), dtype=np.float32)
    full[used] = w
    return full, b


def _notices(rng: random.Random) -> tuple[list[str], list[str]]:
    texts, labels = [], []
    lead = ["", "", "", "Note: ", "* ", "# ", "// ", "License: ", "Copyright (c) 2019 Jane Roe. ", "(c) 2021 The Authors - "]
    tail = ["", "", "", " See the LICENSE file.", " See above.", " Thank you.", " Version 1.2"]
    vary = lambda t: rng.choice(lead) + rng.choice([t, t, t.upper(), t.lower(), t.rstrip("."), t.replace("License", "Licence")]) + rng.choice(tail)
    for name, forms in FAMILIES.items():
        for t in forms:
            for _ in range(12):
                texts.append(vary(t))
                labels.append(name)
    for _ in range(500):
        a, b = rng.sample(ODD, 2)
        texts.append(vary(rng.choice(UNKNOWN_FORMS).format(a.title(), b.title(), f"{rng.randrange(1, 6)}.{rng.randrange(0, 9)}")))
        labels.append("unknown")
    return texts, labels


def train(negatives: list[str], seed: int = 5) -> Classifier:
    rng = random.Random(seed)
    names = [*sorted(FAMILIES), "unknown", "none"]
    texts, labels = _notices(rng)
    plain = [*negatives, *PLAIN * 10]
    texts, labels = texts + plain, labels + ["none"] * len(plain)
    y = np.array([names.index(x) for x in labels])
    held = np.array([rng.random() < 0.2 for _ in texts])
    buf, off = _pack(texts)
    x, row, _, _ = features(buf, off)

    def part(mask):
        new = np.cumsum(mask) - 1
        k = mask[row]
        return x[k], new[row[k]], int(mask.sum()), y[mask]

    weights, bias = _descend(*part(~held), len(names), len(names) - 1)
    hx, hrow, n, hy = part(held)
    o = np.lexsort((hrow,))
    hx, hrow = hx[o], hrow[o]
    z = np.stack([np.bincount(hrow, weights=weights[hx, k], minlength=n) for k in range(len(names))], axis=1) + bias

    def loss(t):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(n), hy]).mean())

    temperature = min(np.geomspace(0.3, 8, 40), key=loss)
    gate, gate_bias = _descend(x, row, len(texts), (y != len(names) - 1).astype(int), 2, 0)
    grams = {}
    for name, forms in FAMILIES.items():
        buf, off = _pack(forms)
        _, _, three, line = features(buf, off)
        grams[name] = [np.unique(three[line == k]) for k in range(len(forms))]
    return Classifier(names, (gate[:, 1] - gate[:, 0]).copy(), float(gate_bias[1] - gate_bias[0]), weights, bias, float(temperature), grams)


def fit(docs: DataFrame, text_col: str = "text", rows: int = NEGATIVES) -> Classifier:
    lines = docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).where(F.length(F.trim("line")) > 20).where(~F.col("line").rlike(HINT))
    # hashes first, so that no executor sorts texts
    cut = lines.select(F.xxhash64("line").alias("h")).distinct().orderBy("h").limit(rows)
    chosen = lines.withColumn("h", F.xxhash64("line")).join(F.broadcast(cut), "h", "left_semi").groupBy("h").agg(F.min(F.substring("line", 1, 2000)).alias("line"))
    return train([r.line for r in chosen.orderBy("h").collect()])


OUT = "doc_id long, n_lines long, n_notices long, families array<string>, family string, confidence double, status string"


def scan_texts(model: Classifier, buf: np.ndarray, off: np.ndarray, sure: float, cover: float) -> list[tuple]:
    cut, owner = lines_of(buf, off)
    n = len(off) - 1
    found: list[list] = [[] for _ in range(n)]
    if len(owner):
        x, row, three, trow = features(buf, cut)
        score = np.bincount(row, weights=model.gate[x], minlength=len(owner)) + model.gate_bias
        words = np.bincount(row, minlength=len(owner))
        # the threshold is low: a false line costs one look by the family model
        open_ = np.flatnonzero((score > -2) & (words > 0))
        if len(open_):
            inside = np.zeros(len(owner), dtype=bool)
            inside[open_] = True
            k = inside[row]
            x, row = x[k], row[k]
            one = np.unique(row * (1 << BITS) + x)
            row, x = one >> BITS, one & ((1 << BITS) - 1)
            logits = np.stack([np.bincount(row, weights=model.weights[x, c], minlength=len(owner))[open_] for c in range(len(model.names))], axis=1)
            first = np.ones(len(open_), dtype=bool)
            first[1:] = (open_[1:] != open_[:-1] + 1) | (owner[open_[1:]] != owner[open_[:-1]])
            starts = np.flatnonzero(first)
            for s, e in zip(starts, [*starts[1:], len(open_)]):
                # a line that is none on its own splits the paragraph around it
                run: list[int] = []
                for i in [*range(s, e), -1]:
                    if i >= 0 and (logits[i] + model.bias).argmax() != len(model.names) - 1:
                        run.append(i)
                    elif run:
                        z = (logits[run].sum(axis=0) + model.bias) / model.temperature
                        p = np.exp(z - z.max())
                        p /= p.sum()
                        best = int(p.argmax())
                        name, status = model.names[best], "unknown"
                        if name not in ("unknown", "none") and p[best] >= sure:
                            here = np.unique(three[(trow >= open_[run[0]]) & (trow <= open_[run[-1]])])
                            share = max((np.isin(t, here).mean() for t in model.templates[name] if len(t)), default=0.0)
                            status = "confirmed" if share >= cover else "predicted"
                        else:
                            name = "unknown"
                        found[owner[open_[run[0]]]].append((status, float(p[best]), name))
                        run = []
    rank = {"confirmed": 0, "predicted": 1, "unknown": 2}
    lines = np.bincount(owner, minlength=n)
    out = []
    for i in range(n):
        best = min(found[i], key=lambda f: (rank[f[0]], -f[1], f[2]), default=("none", 0.0, None))
        out.append((int(lines[i]), len(found[i]), sorted({f[2] for f in found[i]}), best[2], round(best[1], 6), best[0]))
    return out


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.5, cover: float = 0.6) -> DataFrame:
    """One row a document: its notices' families, the best one, its probability and status."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.texts(batch.column(1))
            for i, j in K.chunks(off):
                rows = scan_texts(shared.value, buf[off[i] : off[j]], off[i : j + 1] - off[i], sure, cover)
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=["doc_id", "n_lines", "n_notices", "families", "family", "confidence", "status"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUT)
