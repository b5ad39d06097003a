import random

import pytest

from logloom.llm import license as L
from logloom.llm.license_text import FAMILIES, ODD


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return L.train([" ".join(rng.choice("alpha bravo the of and to it is was river house tree".split()) for _ in range(9)) for _ in range(300)])


def status(model, *texts):
    return [(r[3], r[5]) for r in L.scan_texts(model, *L.K.texts(L.pa.array([t.encode() for t in texts], L.pa.binary())), 0.5, 0.6)]


def test_families_and_none(model):
    texts = ["It was a river.\n" + forms[0] + "\nThe house of the tree." for forms in FAMILIES.values()]
    assert status(model, *texts) == [(name, "confirmed") for name in FAMILIES]
    assert status(model, "It was a river and a tree to the house.", "", "\n\n") == [(None, "none")] * 3


def test_held_out_notices(model):
    texts, labels = L._notices(random.Random(99))
    got = status(model, *texts)
    assert sum(g[0] == want for g, want in zip(got, labels)) / len(labels) > 0.93
    odd = [f"Licensed under the {a.title()} {b.title()} License, version 7.3." for a, b in zip(ODD, ODD[5:])]
    assert sum(g == ("unknown", "unknown") for g in status(model, *odd)) / len(odd) > 0.8


def test_notice_over_lines(model):
    t = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software\nand associated documentation files, to deal in the Software without restriction"
    assert status(model, t) == [("MIT", "confirmed")]


def test_table(spark, model):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "All rights reserved.", "x"), (3, "a b\n" * 60000 + "Released under the MIT License.", "y")], "doc_id long, text string, status string")
    got = {r.doc_id: (r.family, r.status, r.n_lines) for r in L.scan(df, model).collect()}
    assert got[1] == got[2] == (None, "none", 0) and got[None][0] == "proprietary" and got[3] == ("MIT", "confirmed", 60001)
    assert L.scan(df.limit(0), L.fit(df.limit(0))).count() == 0
