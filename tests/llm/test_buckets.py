import random

from logloom.llm import buckets
from logloom.llm.scratch import Scratch


def family(size, pivots):
    """Sets near the threshold to one another, each beside several pivots, and their stars."""
    rng = random.Random(5)
    sets = {}
    for i in range(size):
        keep = rng.sample(range(60), rng.randrange(48, 58))
        sets[i] = {f"{k}" for k in keep} | {f"x{rng.randrange(30)}" for _ in range(rng.randrange(0, 8))}
    star = [(p, i) for i in sets for p in rng.sample(range(pivots), 4) if p != i]
    return sets, star


def met(spark, sets, star):
    code = {h: k for k, h in enumerate(sorted({h for v in sets.values() for h in v}))}
    named = spark.createDataFrame([(p, i, i) for p, i in star], "p long, id long, c long")
    elements = spark.createDataFrame([(i, code[h]) for i, v in sets.items() for h in v], "id long, h long")
    sizes = spark.createDataFrame([(i, len(v)) for i, v in sets.items()], "id long, n long")
    s = Scratch(spark, "met")
    pairs = {(r.x, r.y) for r in buckets._met(named, lambda ids: elements.join(ids, "id", "left_semi"), sizes, s, 80).collect()}
    return pairs, spark.read.parquet(s.path("rows")).count()


def test_a_member_of_many_groups_comes_once(spark):
    sets, star = family(90, 12)
    pairs, rows = met(spark, sets, star)
    want = {(x, y) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
    assert len(want) > 100 and want <= pairs
    assert rows == sum(len(sets[i]) for i in {i for _, i in star})


def test_fields_apart_do_not_meet(spark):
    sets, star = family(80, 10)
    twins = {i + 1000: v for i, v in sets.items()}
    pairs, rows = met(spark, sets | twins, star + [(p + 1000, i + 1000) for p, i in star])
    assert pairs and all((x < 1000) == (y < 1000) for x, y in pairs)
    assert rows == 2 * sum(len(v) for v in sets.values())
