"""Vector arithmetic as columns, and a deterministic lexical embedder."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What a word is, prefixes of the features, default width.
WORD = re.compile(r"[0-9a-zA-Z_.:/@-]+")
DIM = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column) -> Column:
    return F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, vectors of different lengths and zero vectors."""
    n = norm2(a) * norm2(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot(a, b) / F.sqrt(n)).otherwise(0.0)


def normalise(a: Column) -> Column:
    n = F.sqrt(norm2(a))
    return F.when(n > 0, F.transform(a.cast("array<double>"), lambda x: x / n)).otherwise(a.cast("array<double>"))


def features(text: str) -> dict[str, int]:
    """Words and character trigrams of the lower-cased text, white space squeezed, with their counts."""
    low = text.lower()
    out: dict[str, int] = {}
    squeezed = re.sub(r"\s+", " ", low)
    for f in [*("w:" + w for w in WORD.findall(low)), *("g:" + g for i in range(len(squeezed) - 2) if (g := squeezed[i : i + 3]).strip())]:
        out[f] = out.get(f, 0) + 1
    return out


def embed(text: str, dim: int = DIM) -> np.ndarray:
    """Signed hashing of the features, weighted 1 + ln(count), of length 1."""
    v = np.zeros(dim)
    for f, n in features(text).items():
        h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
        v[h % dim] += (1.0 if h >> 63 else -1.0) * (1.0 + math.log(n))
    size = math.sqrt(float((v * v).sum()))
    return v / size if size else v


def embedder(dim: int = DIM):
    """A pandas UDF of :func:`embed`; another model takes its place by giving array<double> for texts."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([embed(t or "", dim).tolist() for t in texts])

    return run
