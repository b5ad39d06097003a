from pyspark.sql import functions as F

from logloom.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    d = docs.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)))
    model = langid.fit(d.where("half = 0"))
    # by text alone: neither the declared language nor the source is given
    out = langid.identify(d.where("half = 1"), model, ["doc_id", "lang", "n_chars"])
    rows = out.where("kept AND n_chars >= 60").collect()
    assert len(rows) > 300 and sum(r.language == r.lang for r in rows) / len(rows) >= 0.95


def test_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None, None, None, 5), (2, "", "en", "a", 5), (3, "12345 !!! 67", "en", "a", 5), (None, "the and of to in is", None, "a", 5), (4, "x", "zz", "b", 5), (4, "x", "zz", "b", 5)], "doc_id long, text string, lang string, source string, row int")
    out = langid.identify(odd, model, ["doc_id"], declared="lang", host="source").collect()
    assert len(out) == 6
    assert all(r.language == "unknown" and not r.kept for r in out if r.doc_id in (1, 2, 3))
    assert langid.identify(odd.limit(0), model, ["doc_id"], declared="lang", host="source").count() == 0
    none = langid.fit(docs.limit(0))
    assert {r.language for r in langid.identify(odd, none, ["doc_id"]).collect()} == {"unknown"}


def test_declared_language_and_host_move_an_unclear_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    base = docs.select("doc_id", "text", "lang", F.concat(F.lit("host-"), "lang").alias("host"))
    short = spark.createDataFrame([(-1, "de la", "fr", "host-fr"), (-2, "de la", "es", "host-es")], base.schema)
    got = {r.doc_id: r.language for r in langid.identify(base.union(short), model, ["doc_id"], declared="lang", host="host").where("doc_id < 0").collect()}
    assert got == {-1: "fr", -2: "es"}


def test_rare_languages_are_fitted_in_a_table_of_any_size(spark):
    en, el = "the cat and the dog went home in the rain number", "η γάτα και ο σκύλος πήγαν σπίτι μέσα στη βροχή αριθμός"
    rows = [(k, f"{en} {k}", "en") for k in range(3000)] + [(k, f"{el} {k}", "el") for k in range(3000, 3004)] + [(9000, "ωμέγα", "xx"), (9001, "ωμέγα", "xx")]
    # one id in all rows of a label is one hash
    rows += [(9500, "le chat et le chien rentrent sous la pluie", "fr")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(docs, rows=50)
    assert model.names == ["el", "en", "fr"]
    got = langid.identify(docs.where("lang <> 'xx'"), model, ["lang"]).groupBy("lang", "language", "kept").count().collect()
    assert {(r.lang, r.language, r.kept, r["count"]) for r in got} == {("en", "en", True, 3000), ("el", "el", True, 4), ("fr", "fr", True, 200)}
