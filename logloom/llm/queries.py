"""Thin queries over the operators, one for each, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import decontaminate, html, langid, license, lines, minhash, mixing, oracle, sharding, suffix, vectors


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return license.scan(docs, license.fit(docs))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), temperature=0.5, seed=17)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_read(spark, sf_dir, "documents"), span=200, texts=False)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


MARKUP = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages, by one model: a page declares a language and has an address; a document has a source."""
    docs, pages = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pages")
    model = langid.fit(docs)
    d = langid.identify(docs, model, ["doc_id"], declared="lang", host="source")
    name = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))
    p = pages.select("page_id", F.regexp_replace("html", MARKUP, " ").alias("text"), F.substring(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z-]+)", 1), 1, 2).alias("declared"), F.nullif(name, F.lit("")).alias("host"))
    p = p.withColumn("declared", F.nullif("declared", F.lit(""))).withColumn("suffix", F.regexp_extract("host", r"\.([a-z0-9-]+)$", 1)).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    p = langid.identify(p, model, ["page_id"], declared="declared", suffix="suffix", host="host", domain="domain")
    return d.withColumn("page_id", F.lit(None).cast("long")).unionByName(p.withColumn("doc_id", F.lit(None).cast("long"))).select("doc_id", "page_id", "language", F.round("confidence", 6).alias("confidence"), F.round("p_unknown", 6).alias("p_unknown"), "kept")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), width=2, percent=80).drop("text_hash")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    bad = decontaminate.contaminated(docs, _read(spark, sf_dir, "benchmark"))
    out = docs.select("doc_id").join(bad, "doc_id", "left")
    return out.select("doc_id", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("share", F.lit(0.0)).alias("share"), F.col("items").isNull().alias("kept"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_read(spark, sf_dir, "embeddings"), least=0.98)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the committed version with its shard, read back from the shards."""
    store = sharding.shard(_read(spark, sf_dir, "documents"))
    return store.read().select("doc_id", "shard", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_license, op2_mixing, op3_suffix, op4_lines, op5_langid, op6_minhash, op7_decontaminate, op8_vectors, op9_html, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
