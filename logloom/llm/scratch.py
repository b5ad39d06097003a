"""Intermediate tables in the folder that the cluster shares.

Every iterative operator cuts its lineage by writing a table under
``spark.checkpoint.dir`` and reading it back, so a lost executor costs a reread
of files, never a replay of the whole job, and nothing lives on one machine.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one only where none is set (local tests)."""
    where = spark.sparkContext.getConf().get(CHECKPOINT_KEY, None) or spark.conf.get(CHECKPOINT_KEY, None)
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="logloom-")
        spark.conf.set(CHECKPOINT_KEY, where)
    return where.rstrip("/")


class Scratch:
    """Named tables of one run, below a folder of its own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as a scan with no lineage."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def sweep(self) -> None:
        """Let Spark's cleaner see dead shuffles now rather than at the next full collection.

        A shuffle's handle becomes unreachable only when what the first collection found has been
        dealt with, so a second one follows.
        """
        gc.collect()
        self.spark._jvm.System.gc()
        time.sleep(0.2)
        self.spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound what one Arrow batch of long texts may hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
