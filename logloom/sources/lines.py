"""Raw log lines with a dense sequence number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.text import MAX_LINE


def read_lines(spark: SparkSession, path: str, most: int = MAX_LINE) -> DataFrame:
    """``raw, file, block, row``: lines split at line feeds only, without trailing CR, cut to ``most`` bytes; blank ones are skipped.

    A bare carriage return never ends a line: that would let an attacker forge records.
    """
    df = spark.read.option("lineSep", "\n").text(path)
    place = df.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("row", F.monotonically_increasing_id())
    return clip(place, most)


def clip(df: DataFrame, most: int = MAX_LINE, col: str = "value") -> DataFrame:
    """Bytes stay as they are: a text function would rewrite those that are no UTF-8, which the sanitiser and the fingerprint must see."""
    data = F.col(col).cast("binary")
    # one character a byte, so that the length without line ends is a number of bytes
    end = F.length(F.rtrim(F.decode(data, "ISO-8859-1"), F.lit("\r\n")))
    n = F.when(F.substring(data, -1, 1).isin(b"\r", b"\n"), end).otherwise(F.octet_length(F.col(col)))
    raw = F.substring(data, F.lit(1), F.least(n, F.lit(most))).cast("string")
    return df.withColumn("raw", raw).drop(col).where(F.trim("raw", F.lit(" \t\r\n\x0b\x0c")) != "")


def with_seq(df: DataFrame) -> DataFrame:
    """A dense ``seq`` from 0 in the order of file, block and row, without a global sort.

    Rows are numbered inside their split; only one count a split goes to a prefix sum.
    """
    key = ["file", "block", "part"]
    local = df.withColumn("part", F.shiftright("row", 33)).withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy("row")))
    sizes = df.withColumn("part", F.shiftright("row", 33)).groupBy(*key).agg(F.count("*").alias("size"))
    # one row a split of the input: megabytes at most
    base = sizes.withColumn("base", F.sum("size").over(W.orderBy(*key)) - F.col("size")).drop("size")
    return local.join(base, key).withColumn("seq", (F.col("base") + F.col("n") - 1).cast("bigint")).drop("n", "base", *key, "row")
