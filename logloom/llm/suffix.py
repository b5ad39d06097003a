"""Exact removal of repeated 200-byte strings by a sparse suffix array.

A suffix array of every position needs about 16 bytes a position to be shuffled,
26 times the compressed input. Only some suffixes are sorted here: those that start at
content-defined anchors. The anchor of a ``span``-byte window is the position of the
smallest hash of a ``gram``-byte string inside it, so equal windows have equal anchors
at equal offsets, and about 1.2 % of the positions are anchors. The windows of an
anchor are a contiguous range of starts, and every window belongs to one anchor.

1. Anchors (id, range, gram hash ``h``, hash ``f`` of the whole context from the first
   window's start to the last one's end) are cut from the texts.
2. A gram that occurs once settles its anchor: none of its windows repeats. Anchors with
   equal contexts settle each other: all of their windows repeat; one of them stays.
3. What is left takes its context along. Sampled splitters range-partition the suffixes
   by their leading bytes; each partition sorts its window suffixes by multikey
   quicksort (three-way on one 8-byte token after another) and compares neighbours.
   Equal leading bytes stay in one partition, so nothing is split at its boundaries,
   unless a gram has more than ``hot`` different contexts. The windows of those are
   dealt to blocks of 32, 8 and 1 offsets from the anchor, keyed by all that a block's
   windows have in common, and judged as in 2: groups fall apart into small ones, which
   are compared as above, or into equal contexts, which are aggregated. So one string in
   a third of all documents never meets in one task.

Texts are UTF-8 bytes; null is empty and matches never cross documents. Windows are
judged on the input. Empty and short texts keep all bytes. Every row is a document, so
repeated rows of one id repeat each other and lose all that is long enough; texts of one id
that differ are told apart by a 64-bit hash of id and text, and rows without an id are
documents like others. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import kernels as K
from logloom.llm.scratch import Scratch, partitions, small_batches

POS_BITS = 28
POS_MASK = K.U((1 << POS_BITS) - 1)
NONE = np.iinfo(np.uint64).max
ANCHORS = "doc_id long, n_bytes long, sha string, lo long, wins int, off int, h long, f long"


def anchors(buf: np.ndarray, off: np.ndarray, span: int, gram: int):
    """(row, first window start, number of windows, anchor position, gram hash, context hash)."""
    n = len(buf)
    width = span - gram + 1
    if n < span:
        e = np.zeros(0, dtype=np.int64)
        return e, e, e, e, e.astype(K.U), e.astype(K.U)
    sums = K.prefix(buf)
    _, down = K.powers(n + 1)
    m = n - gram + 1
    h = K.mix((sums[gram:] - sums[:m]) * down[:m])
    packed = (h & ~POS_MASK) | np.arange(m, dtype=K.U)
    # sliding minimum by block prefixes and suffixes
    blocks = -(-m // width)
    v = np.full(blocks * width, NONE, dtype=K.U)
    v[:m] = packed
    v = v.reshape(blocks, width)
    right = np.minimum.accumulate(v, axis=1).reshape(-1)
    left = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    wins = n - span + 1
    best = np.minimum(left[:wins], right[width - 1 : width - 1 + wins]) & POS_MASK
    best = best.astype(np.int64)
    ok = np.zeros(n + 1, dtype=np.int64)
    size = np.diff(off)
    long_enough = np.flatnonzero(size >= span)
    np.add.at(ok, off[long_enough], 1)
    np.add.at(ok, off[long_enough + 1] - span + 1, -1)
    valid = np.cumsum(ok)[:wins] > 0
    cut = np.ones(wins, dtype=bool)
    cut[1:] = (best[1:] != best[:-1]) | ~valid[:-1]
    edge = off[1:-1]
    cut[edge[edge < wins]] = True
    lo = np.flatnonzero(cut & valid)
    stop = np.zeros(wins + 1, dtype=bool)
    stop[:wins] = cut | ~valid
    stop[wins] = True
    stops = np.flatnonzero(stop)
    hi = stops[np.searchsorted(stops, lo, side="right")]
    at = best[lo]
    row = np.searchsorted(off, lo, side="right") - 1
    end = hi - 1 + span
    ctx = K.range_hash(sums, lo, end) ^ K.mix((at - lo).astype(K.U) * K.U(K.BASE2) + (hi - lo).astype(K.U))
    return row, lo, hi - lo, at, h[at], ctx


def _cut(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.texts(batch.column(1))
            ids = batch.column(0)
            for i, j in K.chunks(off):
                part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                raw = part.tobytes()
                sha = [hashlib.sha256(raw[o[k] : o[k + 1]]).hexdigest() for k in range(j - i)]
                row, lo, wins, at, h, f = anchors(part, o, span, gram)
                # a first line for each document, then its anchors
                take = np.concatenate([np.arange(j - i), row])
                k = j - i
                pad = lambda x, t: pa.array(np.concatenate([np.full(k, -1, dtype=t), x.astype(t) if x.dtype != K.U else x.view(t)]))
                head = np.arange(len(take)) < k
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, k).take(pa.array(take)), pa.array(np.diff(o)[take]), pa.array(sha).take(pa.array(take, mask=~head)),
                     pad(lo - o[row], np.int64), pad(wins, np.int32), pad(at - lo, np.int32), pad(h, np.int64), pad(f, np.int64)],
                    names=["doc_id", "n_bytes", "sha", "lo", "wins", "off", "h", "f"],
                )

    return run


def multikey_sort(windows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and which of them equal a neighbour, by group and then by 8-byte tokens.

    ``windows`` is rows x tokens; a level sorts only what is still tied, like the middle
    part of a three-way quicksort, so a row that differs early is not looked at again.
    """
    n, depth = windows.shape
    order = np.argsort(group, kind="stable")
    tie = np.zeros(n, dtype=np.int64)
    if n:
        g = group[order]
        tie[1:] = np.cumsum(g[1:] != g[:-1])
    alive = np.arange(n)
    for level in range(depth):
        if not len(alive):
            break
        rows, t = order[alive], tie[alive]
        size = np.bincount(t, minlength=t.max() + 1 if len(t) else 0)
        keep = size[t] > 1
        alive, rows, t = alive[keep], rows[keep], t[keep]
        if not len(alive):
            break
        w = windows[rows, level]
        o = np.lexsort((w, t))
        rows, w, t2 = rows[o], w[o], t[o]
        order[alive] = rows
        cut = np.ones(len(t2), dtype=np.int64)
        cut[1:] = (t2[1:] != t2[:-1]) | (w[1:] != w[:-1])
        tie[alive] = np.cumsum(cut) + n * (level + 1)
        tie[alive] -= tie[alive].min() if len(alive) else 0
    same = np.zeros(n, dtype=bool)
    if len(alive):
        t = tie[alive]
        size = np.bincount(t - t.min())
        same[order[alive]] = size[t - t.min()] > 1
    return order, same


def _tokens(buf: np.ndarray, start: np.ndarray, span: int) -> np.ndarray:
    depth = -(-span // 8)
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.empty((len(start), depth), dtype=K.U)
    for k in range(depth):
        at = start + min(8 * k, span - 8)
        out[:, k] = np.ascontiguousarray(view[at]).view(">u8")[:, 0]
    return out


def _runs(doc: np.ndarray, start: np.ndarray, span: int):
    """Merge (document, window start) marks, sorted by both, into byte ranges."""
    if not len(doc):
        return doc, start, start
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], start[last] + span


def _compare(span: int, block: int = 2048):
    """mapInArrow over contexts sorted by leading bytes and gram: byte ranges that repeat."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        buf, off = K.texts(t.column("ctx"))
        wins = t.column("wins").to_numpy()
        doc, lo, anchor, h, want = (t.column(c).to_numpy() for c in ("doc_id", "lo", "off", "h", "want"))
        total = int(wins.sum())
        row = np.repeat(np.arange(len(wins)), wins)
        k = np.arange(total) - np.repeat(np.cumsum(wins) - wins, wins)
        start = off[:-1][row] + k
        group = K.mix(h[row].view(K.U)) + (anchor[row] - k).astype(K.U)
        _, same = multikey_sort(_tokens(buf, start, span), group)
        same &= want[row]
        d, s, e = _runs(doc[row][same], (lo[row] + k)[same], span)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], names=["doc_id", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += len(batch)
            if rows < block:
                continue
            t = pa.concat_tables(held)
            h = t.column("h").to_numpy()
            # the last gram may go on in the next batch
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
            if cut:
                yield solve(t.slice(0, cut))
            held, rows = [t.slice(cut)], len(t) - cut
        if rows:
            yield solve(pa.concat_tables(held))

    return run


def _contexts(span: int, gram: int):
    """mapInArrow on (doc_id, text, list of anchors): each anchor's context and its leading bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.texts(batch.column(1))
            lists = batch.column(2)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            lo, wins, at = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "wins", "off"))
            start = off[:-1][row] + lo
            size = wins - 1 + span

            for i in range(0, len(lo), 4096):
                p = slice(i, i + 4096)
                k = len(lo[p])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[p])), flat.field("lo").slice(i, k), flat.field("wins").slice(i, k), flat.field("off").slice(i, k), flat.field("h").slice(i, k), flat.field("want").slice(i, k), flat.field("hot").slice(i, k),
                     _slices(buf, (start + at)[p], np.full(k, gram)), _slices(buf, start[p], size[p])],
                    names=["doc_id", "lo", "wins", "off", "h", "want", "hot", "lead", "ctx"],
                )

    return run


ROWS = "doc_id long, lo long, wins int, off int, h long, f long, want boolean, lead binary, ctx binary"


def _split(span: int, width: int, gram: int):
    """mapInArrow over contexts: the same windows in blocks of ``width`` offsets from the anchor.

    The new gram is what all windows of a block have in common, ``span - width + 1`` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = K.texts(batch.column(6))
            lo, wins, off, h = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3, 4))
            first, last = (off - wins + 1) // width, off // width
            n = last - first + 1
            row = np.repeat(np.arange(len(n)), n)
            block = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            j1 = np.minimum(off[row], block * width + width - 1)
            j0 = np.maximum(off[row] - wins[row] + 1, block * width)
            start = at[:-1][row] + off[row] - j1
            core = at[:-1][row] + off[row] - block * width
            sums = K.prefix(buf)
            key = K.mix(K.range_hash(sums, core, core + span - width + 1) + K.mix(h[row].view(K.U) * K.U(K.BASE2) + block.astype(K.U)))
            size = j1 - j0 + span
            f = K.range_hash(sums, start, start + size) ^ K.mix(j1.astype(K.U) * K.U(K.BASE2) + (j1 - j0).astype(K.U))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(lo[row] + off[row] - j1), pa.array((j1 - j0 + 1).astype(np.int32)), pa.array(j1.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(f.view(np.int64)), batch.column(5).take(pa.array(row)),
                 _slices(buf, core, np.full(len(row), gram)), _slices(buf, start, size)],
                names=["doc_id", "lo", "wins", "off", "h", "f", "want", "lead", "ctx"],
            )

    return run


def _slices(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    o = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(size, out=o[1:])
    idx = np.repeat(start - o[:-1], size) + np.arange(o[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(o), pa.py_buffer(buf[idx].tobytes())]).cast(pa.binary())


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to the digest and the remaining bytes."""
    for batch in batches:
        buf, off = K.texts(batch.column(1))
        lists = batch.column(2)
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        flat = lists.flatten()
        s, e = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s", "e"))
        removed, spans, sha, kept = [], [], [], []
        for i in range(len(batch)):
            raw = buf[off[i] : off[i + 1]]
            mark = np.zeros(len(raw) + 1, dtype=np.int32)
            np.add.at(mark, np.minimum(s[at[i] : at[i + 1]], len(raw)), 1)
            np.add.at(mark, np.minimum(e[at[i] : at[i + 1]], len(raw)), -1)
            gone = np.cumsum(mark[:-1]) > 0
            left = raw[~gone].tobytes()
            removed.append(int(gone.sum()))
            spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and bool(gone[0]))))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _judge(rows: DataFrame, s: Scratch, tag: str, span: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Ranges settled by equal contexts, and the rows of grams that occur in different contexts."""
    ctx = s.save(f"classes{tag}", rows.groupBy("h", "f").agg(F.count("*").alias("nf"), F.min("doc_id").alias("one")))
    kinds = s.save(f"kinds{tag}", ctx.groupBy("h").agg(F.count("*").alias("nc"), F.sum("nf").alias("nh")).where("nh > 1"))
    j = s.save(f"judged{tag}", rows.join(ctx, ["h", "f"]).join(kinds, "h").drop("f", "nh"))
    s.drop(f"classes{tag}", f"kinds{tag}")
    settled = j.where("nf > 1").select("doc_id", F.col("lo").alias("s"), (F.col("lo") + F.col("wins") - 1 + span).alias("e"))
    left = j.where("nc > 1 AND (nf = 1 OR doc_id = one)").withColumn("want", F.col("want") & (F.col("nf") == 1)).withColumn("hot", F.col("nc") > hot)
    return settled, left.drop("nf", "one", "nc")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200, gram: int = 64, hot: int = 256, texts: bool = True) -> DataFrame:
    """One row a document; ``kept`` (the remaining bytes) only with ``texts``."""
    spark = docs.sparkSession
    small_batches(spark, 128)
    s = Scratch(spark, "suffix")
    # until the end a document goes by the hash of its id and text, so texts of one id, or of none, are documents of their own
    plain = docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("text")).withColumn("doc_id", F.xxhash64("own", "text"))
    cut = s.save("cut", plain.select("doc_id", "text").mapInArrow(_cut(span, gram), ANCHORS))
    heads = cut.where("lo < 0").select("doc_id", "n_bytes", "sha")
    a = cut.where("lo >= 0").select("doc_id", "lo", "wins", "off", "h", "f")
    grams = s.save("grams", a.groupBy("h").count().where("count > 1").select("h"))
    b = s.save("repeated", a.join(grams, "h"))
    s.sweep()
    settled, open_ = _judge(b.withColumn("want", F.lit(True)), s, "0", span, hot)
    s.drop("repeated", "grams")
    spans = [settled]
    open_ = open_.select("doc_id", F.struct("lo", "wins", "off", "h", "want", "hot").alias("x"))
    lists = open_.groupBy("doc_id").agg(F.collect_list("x").alias("x"))
    taken = lists.join(plain, "doc_id").select("doc_id", "text", "x").mapInArrow(_contexts(span, gram), "doc_id long, lo long, wins int, off int, h long, want boolean, hot boolean, lead binary, ctx binary")
    taken = s.save("contexts", taken)
    s.sweep()
    few, many = [taken.where("NOT hot")], taken.where("hot")
    for width in (32, 8, 1):
        if many.isEmpty():
            break
        parts = s.save(f"parts{width}", many.select("doc_id", "lo", "wins", "off", "h", "want", "ctx").mapInArrow(_split(span, width, gram), ROWS))
        settled, open_ = _judge(parts, s, str(width), span, hot)
        spans.append(settled)
        few.append(open_.where("NOT hot"))
        many = open_.where("hot")
    cold = reduce(DataFrame.unionByName, [x.select("doc_id", "lo", "wins", "off", "h", "want", "lead", "ctx") for x in few])
    cold = cold.repartitionByRange(partitions(spark), "lead").sortWithinPartitions("lead", "h")
    spans.append(s.save("found", cold.mapInArrow(_compare(span), "doc_id long, s long, e long")))
    spans = reduce(DataFrame.unionByName, spans)
    spans = s.save("spans", spans.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    s.drop("contexts", "found")
    s.sweep()
    changed = plain.join(spans, "doc_id").select(F.col("own").alias("doc_id"), "text", "spans").mapInArrow(_remove, OUT)
    if texts:
        same = plain.join(spans, "doc_id", "left_anti").select(F.col("own").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("kept"))
        same = same.select("doc_id", F.length("kept").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept")
        return changed.unionByName(same)
    names = plain.select("doc_id", "own").distinct()
    same = heads.join(spans, "doc_id", "left_anti").join(names, "doc_id").select(F.col("own").alias("doc_id"), "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return changed.drop("kept").unionByName(same)
