import random

from pyspark.sql import functions as F

from logloom.llm import lines


def brute(rows, width=8, percent=80):
    """Kept text of each (id, text) by comparing every two lines."""
    occ = {}
    for d, t in sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, x in enumerate(t.split("\n")):
            x = x.strip(lines.BLANKS)
            if x:
                occ.setdefault(x, (d, t, k))
    names = list(occ)
    sets = {x: {x[i : i + width] for i in range(max(1, len(x) - width + 1))} for x in names}
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    first = {}
    for x in names:  # in order of first occurrence
        first.setdefault(find(x), occ[x])
    keep = set(first.values())
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        left = [x for k, x in enumerate(parts) if not x.strip(lines.BLANKS) or (d, t or "", k) in keep]
        out.append((d, len(parts), len(parts) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghilmnoprstuäéß漢") for _ in range(rng.randint(2, 8))) for _ in range(80)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(30)]
    rows = []
    for d in range(60):
        part = []
        for _ in range(rng.randint(0, 6)):
            x = rng.choice(base)
            if rng.random() < 0.5:
                w = x.split(" ")
                w[rng.randrange(len(w))] = rng.choice(words)
                x = " ".join(w)
            part.append(rng.choice(["", " ", "\t"]) + x + rng.choice(["", "\r", " "]))
            if rng.random() < 0.2:
                part.append(rng.choice(["", "  "]))
        rows.append((d, "\n".join(part)))
    rows += [(None, "abc\nabc"), (7, "zzz zzz zzz\n"), (100, None), (101, ""), (102, "\n\n"), (3, rows[3][1]), (103, "long " * 20_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, line int").repartition(5)
    got = sorted([tuple(r) for r in lines.dedup_lines(df).collect()], key=str)
    assert got == brute(rows)


def test_repetitive_lines_of_any_length(spark):
    # few distinct shingles at many positions; equal sets beside near ones
    rule = ["-" * n for n in (73, 80, 300, 5_000)]
    laugh = ["Ha " * n for n in (20, 60, 700)]
    cycle = ["abcdefghijklmnopqrstuvwxyz0123456789" * n + tail for n, tail in ((2, ""), (40, "xy"), (900, ""), (2_000, "z"))]
    pairs = [(chr(0x4E00 + k) * 3 + "=~") * n for k in range(30) for n in (4, 2_000)]
    rows = [(d, t) for d, t in enumerate(rule + laugh + cycle + pairs)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted([tuple(r) for r in lines.dedup_lines(df).collect()], key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) == len(rows) - 33


def test_empty_table_has_no_rows(spark):
    out = lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_lines", "n_removed", "kept"] and out.count() == 0


def _keys(df, width=8):
    u, h, m, keys = lines._signatures("line", width)
    return df.select("*", u).select("id", h).select("id", "h", m).select("id", F.size("h").alias("n"), keys)


def test_signatures_stay_native_and_in_the_row(spark):
    plan = _keys(spark.createDataFrame([(1, "a line")], "id long, line string"))._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Exchange", "Generate", "Python", "Arrow", "Pandas") if x in plan]


def test_recall_of_the_bands_at_the_threshold(spark):
    rng = random.Random(5)
    rows, k = [], 0
    sets = lambda x: {x[i : i + 8] for i in range(max(1, len(x) - 7))}
    while k < 3000:
        x = "".join(rng.choice("abcdefghij klmnopqr") for _ in range(rng.choice([20, 60, 150, 400, 900])))
        y = list(x)
        for _ in range(max(1, round(len(x) / 9 / 8 * rng.uniform(0.6, 1.2)))):
            y[rng.randrange(len(y))] = rng.choice("uvwxyz")
        a, b = sets(x), sets("".join(y))
        if 0.8 <= len(a & b) / len(a | b) <= 0.84:
            rows += [(2 * k, x), (2 * k + 1, "".join(y))]
            k += 1
    keys = _keys(spark.createDataFrame(rows, "id long, line string").repartition(4)).select(F.expr("id div 2").alias("k"), "keys")
    met = keys.groupBy("k").agg(F.arrays_overlap(F.min("keys"), F.max("keys")).alias("ok"))
    assert met.where("NOT ok").count() <= 4
    assert keys.agg(F.max(F.size("keys"))).first()[0] <= 16


def test_a_family_around_the_threshold(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvw xyz") for _ in range(300))
    rows = []
    for d in range(70):
        x = list(base)
        for _ in range(rng.randint(1, 7)):
            x[rng.randrange(len(x))] = rng.choice("0123456789")
        rows.append((d, "".join(x)))
    got = sorted([tuple(r) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()], key=str)
    assert got == brute(rows)


def test_signatures_are_of_the_smallest_hashes(spark):
    # lines of few and many distinct shingles, below and above the length from which hashes are bounded
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("abcdefghij klmnopqrsé漢😀") for _ in range(n))
    texts = [some(n) for n in (1, 7, 8, 9, 23, 24, 70, 71, 72, 179, 180, 181, 187, 188, 400, 5_000)]
    texts += [some(n) * 300 for n in (1, 2, 15, 16, 17, 63, 64, 65, 111, 300)] + [some(40) * 50 + some(k) for k in (20, 24, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, line string").repartition(3)
    u, h, m, keys = lines._signatures("line", 8)
    sets = {r.id: r.s for r in df.select("id", u).select("id", lines._set("u", 8).alias("s")).collect()}
    got = df.select("id", u).select("id", h).select("id", "h", m).select("id", "h", "m", keys).collect()
    assert len(got) == len(texts) and any(len(v) > 64 for v in sets.values()) and any(len(v) < 64 < len(texts[k]) for k, v in sets.items())
    for r in got:
        assert len(sets[r.id]) == len({texts[r.id][i : i + 8] for i in range(max(1, len(texts[r.id]) - 7))})
        assert r.h == sorted(sets[r.id])[:64]
        turned = [((x & 15) << 60 | (x >> 4) & (1 << 60) - 1) for x in r.h]
        assert r.m == sorted(x - (1 << 64) if x >> 63 else x for x in turned)
        starts = [i for i in range(len(r.m)) if len(r.m) <= 16 or i == 0 or r.m[i] >> 60 != r.m[i - 1] >> 60]
        rows = spark.createDataFrame([tuple(r.m[(i + j) % len(r.m)] for j in range(4)) for i in starts], "a long, b long, c long, d long")
        assert sorted(r["keys"]) == sorted({x.k for x in rows.select(F.xxhash64("a", "b", "c", "d").alias("k")).collect()})


def test_sizes_settle_pairs_before_sets_are_built(spark):
    texts = ["abcdefghijklmnopqrstuvwxyz" + "0123456789" * k + tail for k in (0, 1, 3) for tail in ("", "!", "AB" * 9)]
    near = spark.createDataFrame(list(enumerate(texts)), "id long, line string").select("id", "line", F.encode("line", "UTF-32").alias("u"))
    near = near.select("id", "line", F.size(lines._set("u", 8)).cast("long").alias("n"))
    ids = range(len(texts))
    pairs = spark.createDataFrame([(x, y) for x in ids for y in ids if x < y], "x long, y long")
    got = {(r.x, r.y): (r.both, r.either) for r in lines._distances(near, 8, 80)(pairs).collect()}
    sets = [{x[i : i + 8] for i in range(len(x) - 7)} for x in texts]
    want = {(x, y): (len(sets[x] & sets[y]), len(sets[x] | sets[y])) for x in ids for y in ids if x < y and 100 * min(len(sets[x]), len(sets[y])) >= 80 * max(len(sets[x]), len(sets[y]))}
    assert got == want and 0 < len(want) < len(ids) * (len(ids) - 1) // 2


def test_the_bound_of_hashes_holds_for_any_length(spark):
    at = [4, 720, 724, 4_000, 250_000, 2_000_000_000, 2_147_483_644]
    df = spark.createDataFrame([(n,) for n in at], "n int").selectExpr("n", f"{lines._bound('n')} AS t")
    got = {r.n: r.t for r in df.collect()}
    assert got[4] == got[720] == 2**63 - 1
    for n in at[2:]:
        assert abs((got[n] + 2**63) / 2**64 * (n // 4) - 112) < 0.01
