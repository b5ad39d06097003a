import pyarrow as pa

from logloom.llm import decontaminate as D
from logloom.llm import kernels as K


def template(text):
    buf, off = K.texts(pa.array([text.encode()], pa.binary()))
    start, end, _, h, slot = D.tokens(buf, off)
    names = {int(D.NUM): "NUM", int(D.NAME): "NAME", int(D.UNIT): "UNIT"}
    return [names.get(int(x)) if s else bytes(buf[a:b]).decode().lower() for a, b, x, s in zip(start, end, h, slot)]


def test_template():
    assert template("A train with John Smith goes 3,141.5 km in 2hours. Then it stops") == ["a", "train", "with", "NAME", "goes", "NUM", "UNIT", "in", "NUM", "UNIT", "then", "it", "stops"]
    assert template("") == []


Q = "A train leaves the station with Anna at 40 km per hour and another train follows it at 60 km per hour, so when does the second train of Anna meet the first one?"


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, item_id string, h string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r["items"] for r in D.contaminated(d, b).collect()}, {r.doc_id: r["items"] for r in D.contaminated(d, b, bound=0).collect()}


def test_verbatim_reparameterised_and_clean(spark):
    filler = "the quick brown fox jumps over the lazy dog again and again while nobody looks at it "
    docs = [
        (1, filler + Q + " " + filler),
        (2, filler + Q.replace("40", "72").replace("60", "95").replace("Anna", "Pedro") + filler),
        (3, filler * 3),
        # one name of the item became two different names: the template fits, the slots do not
        (4, filler + Q.replace("with Anna", "with Pedro").replace("of Anna", "of Mia") + filler),
        (5, None), (6, ""), (None, Q), (7, "!!! " + Q.upper().lower().replace(" ", "###  ")), (1, filler),
    ]
    a, b = run(spark, docs, [(10, Q), (11, "Too short"), (12, None), (None, Q)])
    assert a == b
    assert a[1] == [10] and a[2] == [10] and 3 not in a and 4 not in a and 5 not in a
    assert run(spark, docs, [])[0] == {} and run(spark, [], [(10, Q)])[0] == {}
    assert run(spark, [(8, (filler * 20000) + Q)], [(10, Q)])[0] == {8: [10]}


def test_verbatim_copies_of_items_without_template_windows(spark):
    sums = "Compute 3 + 4 x 12 - 7 / 2"
    values = "12, 15.5, 18, 21, 24 and 30 kg, 40 kg, 50 kg"
    names = "Anna Smith Peter Jones Maria Weber Hans Meyer"
    filler = "the quick brown fox jumps over the lazy dog again and again while nobody looks at it "
    items = [(20, sums), (21, values), (22, names), (23, "2 + 2 ="), (24, "!?"), (25, "Élan Vital"), (26, "we met Anna Smith today")]
    docs = [(k, f"{filler} {t}. {filler}") for k, (_, t) in enumerate(items)] + [
        # near, but no copies: other numbers or names, other signs between
        (10, filler + sums.replace("4", "5").replace("12", "13").replace("7", "8") + " " + filler),
        (11, filler + "13, 16.5, 19, 22, 25 and 31 kg, 41 kg, 51 kg " + filler),
        (12, filler + "Carl Otto Paul Kurz Nina Berg Ida Lang " + filler),
        (13, filler + "2 - 2 = 0 " + filler), (14, filler + "COMPUTE  3 + 4 x\n12 - 7 / 2"), (15, sums), (16, filler + " élan\tvital"),
    ]
    a, b = run(spark, docs, items)
    assert a == b == {0: [20], 1: [21], 2: [22], 3: [23], 5: [25], 6: [26], 14: [20], 15: [20], 16: [25]}


def test_verbatim_passage_of_the_weak_part_of_an_item(spark):
    numbers = " ".join(str(k) for k in range(100, 130))
    filler = "the quick brown fox jumps over the lazy dog again and again while nobody looks at it "
    docs = [(1, filler + numbers[:59] + " " + filler), (2, filler + " ".join(str(k) for k in range(200, 215)) + filler)]
    a, b = run(spark, docs, [(30, Q + " Values: " + numbers)])
    assert a == b == {1: [30]}
