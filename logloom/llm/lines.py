"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

Lines are trimmed of blanks; equal lines are one class (an aggregate by 128 hash bits)
before anything else, so a line in a third of all documents is one row. A class's set is
its distinct ``width``-character shingles (a shorter line is one shingle), cut from UTF-32,
where every position is reached in constant time, and hashed inside the row. The band
keys come from one permutation (see ``_signatures``), on the partitioning of the class
aggregate, so no signature is shuffled. With 64 minima, a pair at similarity 0.8 shares no
band with probability (1 - 0.8**4)**16 = 2.2e-4; a test measures it. Candidates of a bucket are
verified by exact Jaccard similarity and joined by the distributed union-find; of each
component the first line stays, by document, then line.

Blank lines always stay. Null text is empty, with no lines; an empty text is one blank
line. Null ids are documents like others. Rows that repeat an id and text are one
document and keep the same lines; rows that repeat an id only are different documents.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.buckets import link, stars
from logloom.llm.scratch import Scratch

BLANKS = " \t\r"


def _hashes(u: str, width: int) -> str:
    """Shingle hashes (64 bits) of a line in UTF-32, four bytes a character, one for every position.

    An array of one binds the bytes, which would else be copied out of the row for every position.
    """
    at = f"sequence(1, greatest(octet_length(b) - {4 * width - 1}, 1), 4)"
    return f"transform(array({u}), b -> transform({at}, i -> xxhash64(substring(b, i, {4 * width}))))[0]"


def _set(u: str, width: int) -> F.Column:
    """Distinct shingle hashes of a line in UTF-32."""
    return F.expr(f"array_distinct({_hashes(u, width)})")


def _bound(octets: str) -> str:
    """What about 112 of the hashes of a line of this many bytes of UTF-32 are at most; the largest hash for up to 180 characters."""
    # in exact powers of two: the smallest hash can be reached, not passed, however long the line
    return f"if({octets} <= 720, {2**63 - 1}, cast({112 * 2**64}D / ({octets} div 4) - {2**63}D as bigint))"


def _signatures(line: str, width: int) -> tuple[F.Column, ...]:
    """Three columns to be selected one after another: smallest shingle hashes ``h``, minima ``m``, band ``keys``.

    One permutation: ``h`` are the 64 smallest distinct hashes, which two sets share like the sets themselves; ``m`` has them in the order of
    their low bits; a band key is the hash of one of them and the three that follow it (the
    last is followed by the first). The 16 bands start at the first minimum of every value of four bits, in a line
    of at most 16 minima at each of them. All of it is made inside the row: a line is one
    row, never one row a character, and its arrays live as long as the row.

    Only hashes below a bound that some 112 of a long line's positions stay under are made distinct and sorted; where
    fewer than 64 are left (few distinct shingles at many positions), all of them are. Lambdas are interpreted, so
    lines of 64 minima, which are most, get their ``m`` and ``keys`` from written-out arrays, which are compiled; the lambdas
    of the others make the same.
    """
    every = _hashes("u", width)
    bound = _bound("octet_length(u)")
    low = f"array_distinct(transform(array({every}), a -> transform(array({bound}), t -> filter(a, x -> x <= t))[0])[0])"
    # ``low`` in both branches, so that it is evaluated once
    h = F.expr(f"slice(sort_array(if(size({low}) >= 64 OR octet_length(u) <= 720, {low}, array_union({low}, {every}))), 1, 64)")
    turned = ", ".join(f"shiftleft(h[{i}], 60) | shiftrightunsigned(h[{i}], 4)" for i in range(64))
    m = F.expr(f"sort_array(if(size(h) = 64, array({turned}), transform(h, x -> shiftleft(x, 60) | shiftrightunsigned(x, 4))))")
    key = [f"xxhash64(m[{i}], m[{(i + 1) % 64}], m[{(i + 2) % 64}], m[{(i + 3) % 64}])" for i in range(64)]
    starts = ", ".join([key[0], *(f"if(shiftright(m[{i}], 60) <> shiftright(m[{i - 1}], 60), {key[i]}, null)" for i in range(1, 64))])
    keys = F.expr(f"""if(size(m) = 64, array_except(array({starts}), array(cast(null as bigint))),
        transform(array(m), m -> transform(filter(sequence(0, size(m) - 1), i -> size(m) <= 16 OR i = 0 OR shiftright(m[i], 60) <> shiftright(m[i - 1], 60)),
        i -> xxhash64(m[i], m[(i + 1) % size(m)], m[(i + 2) % size(m)], m[(i + 3) % size(m)])))[0])""")
    return F.encode(line, "UTF-32").alias("u"), h.alias("h"), m.alias("m"), keys.alias("keys")


def _distances(near: DataFrame, width: int, percent: int):
    """Sizes of the intersection and union, of the pairs whose sets' sizes admit the threshold."""

    def run(pairs: DataFrame) -> DataFrame:
        y, x = (near.select(F.col("id").alias(k), F.col("line").alias(f"l{k}"), F.col("n").alias(f"n{k}")) for k in "yx")
        both = pairs.join(y, "y").join(x, "x").where(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
        wide = both.select("x", "y", (F.col("nx") + F.col("ny")).alias("total"), F.encode("lx", "UTF-32").alias("ux"), F.encode("ly", "UTF-32").alias("uy"))
        n = wide.select("x", "y", "total", F.expr(f"cast(size(array_union({_hashes('ux', width)}, {_hashes('uy', width)})) as bigint) as either"))
        return n.select("x", "y", (F.col("total") - F.col("either")).alias("both"), "either")

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 8, percent: int = 80) -> DataFrame:
    """One row a row of ``docs``: ``doc_id, n_lines, n_removed, kept`` (the remaining text)."""
    s = Scratch(docs.sparkSession, "lines")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    line = plain.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line", F.lit(BLANKS))).where("line <> ''")
    # one aggregate of one column, so that both uses of it are the same exchange
    line = line.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.struct("doc_id", "th", "pos", "line").alias("f"))
    cls = line.groupBy("h1", "h2").agg(F.min("f").alias("f"))
    cls = cls.select(F.struct("f.doc_id", "f.th", "f.pos").alias("first"), "f.line", F.monotonically_increasing_id().alias("id"))
    u, h, m, keys = _signatures("line", width)
    cls = cls.select("*", u).select("id", "first", "line", h).select("id", "first", "line", m).select("id", "first", "line", keys)
    cls = s.save("cls", cls)
    s.sweep()
    # counts first, as a table: their exchange is gone before that of the join is written
    keyed = cls.select("id", F.explode("keys").alias("key"))
    often = s.save("often", keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    s.sweep()
    live = s.save("live", keyed.join(often, "key"))
    s.sweep()
    star = stars(live.join(live.groupBy("id").agg(F.sum("n").alias("score")), "id"))
    star = s.save("stars", star)
    ids = star.select("id").union(star.select("p")).distinct()
    # the size of a set is asked of these only
    near = cls.select("id", "line").join(ids, "id", "left_semi").select("id", "line", F.encode("line", "UTF-32").alias("u"))
    near = s.save("near", near.select("id", "line", F.size(_set("u", width)).cast("long").alias("n")))
    s.drop("live")
    s.sweep()
    tokens = lambda some: near.join(some, "id", "left_semi").select("id", F.encode("line", "UTF-32").alias("u")).select("id", F.explode(_set("u", width)).alias("h"))
    comp = link(star, _distances(near, width, percent), tokens, near.select("id", "n"), s, percent)
    # all classes of a component but the one whose first line comes first
    named = cls.select("id", "first").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    kept = named.groupBy("component").agg(F.min("first").alias("first")).select("first.*")
    kept = s.save("kept", kept.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("pos")).alias("at")))
    s.drop("cls", "near")
    s.sweep()
    k = kept.select(F.col("doc_id").alias("kd"), F.col("th").alias("kt"), "at")
    met = plain.join(k, plain["doc_id"].eqNullSafe(k["kd"]) & (plain["th"] == k["kt"]), "left")
    cut = met.select("doc_id", F.split("text", "\n").alias("lines"), F.coalesce("at", F.array().cast("array<int>")).alias("at"))
    # an array of one binds the lines, which would else be split again for every position
    one = F.expr(f"""transform(array(struct(lines, at)), s -> struct(
        size(s.lines) as n,
        transform(array_sort(concat(s.at, filter(transform(s.lines, (x, i) -> if(trim(BOTH '{BLANKS}' FROM x) = '', i, -1)), i -> i >= 0))), i -> s.lines[i]) as rest))[0]""")
    done = cut.select("doc_id", one.alias("o"))
    return done.select("doc_id", F.col("o.n").cast("long").alias("n_lines"), (F.col("o.n") - F.size("o.rest")).cast("long").alias("n_removed"), F.array_join("o.rest", "\n").alias("kept"))
