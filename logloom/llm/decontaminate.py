"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised inside a sentence) and units (after a
number) turn into typed placeholders, the rest is lower-cased. Windows of ``width``
template tokens of the benchmark are hash-joined with those of the documents. Matches
of one item at one alignment form a run; its placeholders must map consistently, each
benchmark value to one value of the document, which a re-parameterised copy does and a
chance meeting of templates does not. A document is contaminated by an item if
consistent runs hold ``percent`` of the item's windows, or one run spans ``run`` tokens.

Windows of fewer than three plain tokens are no template evidence. Where no template
window of an item starts, its windows of ``width`` raw tokens (lower-cased, names unmerged,
punctuation between them ignored) are joined by their own hash, and at one alignment count
together with template windows whose values are equal, by the same two rules over the item's
raw windows. So verbatim copies of lists of values or names are found. An item of fewer raw
tokens is one window, which must agree in all that stands between its tokens but blanks.

The benchmark's distinct window hashes are sent to the executors as a filter only up to
``bound`` of them (8 bytes each); beyond, every document window goes through the join.

Edge cases: null or empty texts have no windows, nor have texts without letters and digits;
an item of one common word marks every document that holds it; rows without an id are
kept; repeated ids are judged together; an empty benchmark or table gives every document
back as kept. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import kernels as K
from logloom.llm.scratch import Scratch, small_batches

UNITS = "kg g mg lb lbs oz t km m cm mm mi mile miles ft in inch inches l ml s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years c f k w kw v a hz khz mhz ghz b kb mb gb tb usd eur gbp dollar dollars euro euros cent cents percent pct pounds meter meters metre metres liter liters litre litres gram grams kilogram kilograms".split()
NUM, NAME, UNIT = (K.U(0x1111111111111111 * i) for i in (1, 2, 3))
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[128:] = _CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(x) for x in ".!?:;\n\r|\"("]] = True


def pieces(buf: np.ndarray, off: np.ndarray):
    """Raw tokens: start, end, row, hash of the lower-cased bytes, whether it is a number, whether it is capitalised."""
    n = len(buf)
    e = np.zeros(0, dtype=np.int64)
    if not n:
        return e, e, e, e.astype(K.U), e.astype(bool), e.astype(bool)
    kind = _CLASS[buf]
    inner = (buf == 46) | (buf == 44)
    inner[0] = inner[-1] = False
    inner[1:-1] &= (kind[:-2] == 2) & (kind[2:] == 2)
    kind[inner] = 2
    low = K.LOWER[buf]
    wide = np.zeros(n, dtype=bool)
    wide[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    low[wide] += 32
    big = (buf >= 65) & (buf <= 90)
    big[:-1] |= wide[1:]
    first = np.ones(n, dtype=bool)
    first[1:] = kind[1:] != kind[:-1]
    edge = off[1:-1]
    edge = edge[edge < n]
    first[edge] = True
    at = np.flatnonzero(first)
    end = np.append(at[1:], n)
    solid = kind[at] > 0
    start, end = at[solid], end[solid]
    row = np.searchsorted(off, start, side="right") - 1
    return start, end, row, K.range_hash(K.prefix(low), start, end), kind[start] == 2, big[start]


def slots(buf: np.ndarray, raw):
    """Hash with typed placeholders of each raw token, whether it is a name and whether a placeholder."""
    start, end, row, h, number, big = raw
    n = len(buf)
    h = np.where(number, NUM, h)
    same = np.zeros(len(start), dtype=bool)
    same[1:] = row[1:] == row[:-1]
    # a name: capitalised, and nothing that ends a sentence since the token before
    stops = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(_STOP[buf], out=stops[1:])
    calm = np.zeros(len(start), dtype=bool)
    calm[1:] = same[1:] & (stops[start[1:]] == stops[end[:-1]])
    name = big & calm & ~number
    unit = np.zeros(len(start), dtype=bool)
    unit[1:] = number[:-1] & same[1:] & ~number[1:]
    unit &= np.isin(h, _unit_hashes())
    h[name] = NAME
    h[unit] = UNIT
    return h, name, number | name | unit


def tokens(buf: np.ndarray, off: np.ndarray, raw=None):
    """Template tokens: start, end, row, hash and whether it is a placeholder."""
    raw = raw or pieces(buf, off)
    start, end, row, h, number, _ = raw
    if not len(start):
        return start, end, row, h, number
    h, name, slot = slots(buf, raw)
    # neighbouring names are one name
    goes_on = np.zeros(len(start), dtype=bool)
    goes_on[1:] = name[1:] & name[:-1]
    head = np.flatnonzero(~goes_on)
    last = np.append(head[1:], len(start)) - 1
    return start[head], end[last], row[head], h[head], slot[head]


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        buf, off = K.texts(pa.array([u.encode() for u in UNITS], pa.binary()))
        _units.append(K.range_hash(K.prefix(buf), off[:-1], off[1:]))
    return _units[0]


def windows(buf: np.ndarray, off: np.ndarray, width: int, raw=None):
    """Tokens, and hash, row and number of each window that holds enough plain tokens."""
    start, end, row, h, slot = tokens(buf, off, raw)
    m = len(h) - width + 1
    if m <= 0:
        e = np.zeros(0, dtype=np.int64)
        return (start, end, slot), e.astype(K.U), e, e, e
    acc = np.zeros(m, dtype=K.U)
    held = np.zeros(m, dtype=np.int64)
    for i in range(width):
        acc = K.mix(acc * K.U(0x2545F4914F6CDD1D) + h[i : i + m])
        held += slot[i : i + m]
    good = np.flatnonzero((row[width - 1 :] == row[:m]) & (held <= max(0, width - 3)))
    base = np.searchsorted(row, np.arange(len(off) - 1))
    return (start, end, slot), acc[good], row[good], good - base[row[good]], good


def exact(buf: np.ndarray, raw, width: int, whole: bool):
    """Hash, row, number and place of each window of ``width`` raw tokens; ``whole`` adds what stands between them."""
    start, end, row, h = raw[:4]
    m = len(h) - width + 1
    if m <= 0:
        e = np.zeros(0, dtype=np.int64)
        return e.astype(K.U), e, e, e
    acc = np.full(m, K.U(width) * K.U(K.BASE2), dtype=K.U)
    for i in range(width):
        acc = K.mix(acc * K.U(0x2545F4914F6CDD1D) + h[i : i + m])
    if whole:
        # the range's hash without its blanks
        solid = ~K.SPACE[buf]
        at = np.concatenate([[0], np.cumsum(solid)])
        lower = K.LOWER[buf]
        wide = np.zeros(len(buf), dtype=bool)
        wide[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        lower[wide] += 32
        acc = K.mix(acc + K.range_hash(K.prefix(lower[solid]), at[start[:m]], at[end[width - 1 :]]))
    good = np.flatnonzero(row[width - 1 :] == row[:m])
    first = np.searchsorted(row, np.arange(row[-1] + 1))
    return acc[good], row[good], good - first[row[good]], good


def _emit(width: int, wanted=None, short: list[int] | None = None):
    """mapInArrow function: (id, hash, number, values of the window's placeholders, windows of the text, raw number, raw tokens).

    A window of the template has 0 raw tokens. Documents have raw windows of ``width`` and each
    length of ``short``; an item (None) those where no template window starts, or one of its own length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else wanted.value
        for batch in batches:
            buf, off = K.texts(batch.column(1))
            for i, j in K.chunks(off):
                part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                raw = pieces(part, o)
                if not len(raw[0]):
                    continue
                size = np.bincount(raw[2], minlength=j - i)
                (start, end, slot), h, row, k, at = windows(part, o, width, raw)
                heads = np.searchsorted(raw[0], start[at])
                sets = [(0, h, row, k, at, np.bincount(row, minlength=j - i))]
                for x in (*(range(1, width) if short is None else short), width):
                    h, row, k, at = exact(part, raw, x, x < width)
                    total = np.bincount(row, minlength=j - i)
                    if short is None:
                        own = size[row] == x if x < width else ~np.isin(at, heads)
                        h, row, k, at = h[own], row[own], k[own], at[own]
                    sets.append((x, h, row, k, at, total))
                bytes_, base = part.tobytes(), np.cumsum(size) - size
                for x, h, row, k, at, total in sets:
                    if keep is not None and len(h):
                        p = np.searchsorted(keep, h)
                        p[p == len(keep)] = 0
                        hit = keep[p] == h if len(keep) else np.zeros(len(h), dtype=bool)
                        h, row, k, at = h[hit], row[hit], k[hit], at[hit]
                    values = [[]] * len(h) if x else [[bytes_[start[t] : end[t]].decode("utf-8", "replace").lower() for t in range(a, a + width) if slot[t]] for a in at]
                    r = k if x else np.searchsorted(raw[0], start[at]) - base[row]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(k), pa.array(values, pa.list_(pa.string())), pa.array(total[row]), pa.array(r), pa.array(np.full(len(h), x, dtype=np.int32))], names=["id", "h", "k", "v", "n", "r", "x"])

    return run


ROWS = "id long, h long, k long, v array<string>, n long, r long, x int"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = 5, percent: int = 80, run: int = 13, bound: int = 2_000_000) -> DataFrame:
    """One row for each contaminated document: ``doc_id, items`` (sorted), ``share`` (largest, of an item's windows)."""
    spark = docs.sparkSession
    small_batches(spark)
    s = Scratch(spark, "decontaminate")
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col("text")).where("id IS NOT NULL")
    bench = s.save("bench", items.mapInArrow(_emit(width), ROWS).dropDuplicates(["id", "k", "x"]))
    short = sorted(r.x for r in bench.where((F.col("x") > 0) & (F.col("x") < width)).select("x").distinct().collect())
    distinct = bench.select("h").distinct()
    wanted, small = None, distinct.count() <= bound
    if small:
        wanted = spark.sparkContext.broadcast(np.unique(np.array(distinct.toPandas()["h"], dtype=np.int64).view(K.U)))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    hits = plain.mapInArrow(_emit(width, wanted, short), ROWS).select("id", "h", "k", "v", "r", "x")
    b = bench.select(F.col("id").alias("item"), "h", F.col("k").alias("bk"), F.col("v").alias("bv"), "n", F.col("r").alias("br"), "x")
    met = hits.join(F.broadcast(b) if small else b, ["h", "x"])
    # one alignment of an item in a document: its windows and what its placeholders became
    lined = met.where("x = 0").groupBy("id", "item", (F.col("k") - F.col("bk")).alias("shift")).agg(F.collect_set("bk").alias("ks"), F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("bv", "v")))).alias("slots"), F.max("n").alias("n"))
    fits = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda x: x["bv"])))
    # and what of it is verbatim, where that includes windows that are no template evidence
    same = met.where("x > 0 OR v = bv").groupBy("id", "item", (F.col("r") - F.col("br")).alias("shift")).agg(F.collect_set("br").alias("ks"), F.max(F.when(F.col("x") > 0, F.col("n"))).alias("n"))
    judge = lambda runs: runs.groupBy("id", "item").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ks")))).alias("found"), F.max(F.size("ks")).alias("longest"), F.max("n").alias("n"))
    judged = judge(lined.where(fits)).unionByName(judge(same.where("n IS NOT NULL")))
    guilty = judged.where((100 * F.col("found") >= percent * F.col("n")) | (F.col("longest") + width - 1 >= run))
    return guilty.groupBy(F.col("id").alias("doc_id")).agg(F.sort_array(F.collect_set("item")).alias("items"), F.max(F.col("found") / F.col("n")).alias("share"))
