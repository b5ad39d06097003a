"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Each stage is (spark, docs, sf_dir) -> DataFrame over all that the stage before it kept;
all but the last return the columns of documents. Every document that a stage drops is
dropped by that stage's operator alone; an extra column of the input stays.

ORACLE_SQL is None: trained language models, MinHash components and placeholder alignments
have no SQL equivalent; tests/llm/test_pipeline.py holds every stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import decontaminate, langid, minhash, mixing, sharding
from logloom.llm.scratch import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the text model, their declaration and their source support.

    ``lang`` is both the label of the bounded sample that the model is fitted on and a document's declared
    language: the documents have no other declaration. Null or empty texts are judged by declaration and source
    alone; repeated rows are judged alike; an empty table gives an empty one.
    """
    model = langid.fit(docs)
    found = langid.identify(docs, model, docs.columns, text="text", declared="lang", host="source")
    return found.where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.8 of five-word shingles.

    A row goes by its id and its text, so another text of the same id stays. Rows without words and rows with a null id stay; rows
    that repeat both id and text are one document and go or stay together. An empty table gives an empty one.
    """
    lost = minhash.near_duplicates(docs, width=5, percent=80).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).distinct()
    gone = docs["doc_id"].cast("long").eqNullSafe(lost["_id"]) & (F.xxhash64(docs["text"]) == lost["_text"])
    return docs.join(lost, gone, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts stay, rows of one id go or stay together."""
    bad = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(bad.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources approach their target weights, in global random order; rows of one id get one count, a null source is one of its own."""
    return mixing.mix(docs, temperature=0.5, seed=17).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the committed shards with the shard that holds it; null texts count no bytes, an empty table commits an empty version."""
    store = sharding.shard(docs)
    return store.read().select(*docs.columns, "shard")


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = scratch.save(name, out)
    return docs
