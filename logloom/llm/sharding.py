"""Sharding by size-tiered compaction with a versioned manifest.

Arrivals are appended as small immutable shards of about ``arrival_bytes``. Compaction
puts the live shards of one size tier (floor of log4 of their bytes over
``arrival_bytes``) in order of arrival and cuts them into runs of ``target_bytes``; a run
of several shards is rewritten as one shard, the others stay. Every job writes its data and its
manifest rows to folders of its own, named by a random run id, then publishes the version by
renaming one small file, which names them, to the version's name; that rename refuses a name that
exists, so of two writers one fails. A reader sees a whole version or none; a job that dies, is
repeated or loses leaves only folders that no version names.
``vacuum`` keeps what the last ``retain`` versions name and what is younger than ``grace_s``.

Plans are made of sizes only, by window functions over one row a shard. Rewriting is one
exchange keyed by the new shard, each of which is bounded by the target and an arrival, into as
many partitions as the plan has runs.

Null text counts no bytes; null ids are dealt like the word null; repeated rows go to
one arrival together; an empty table commits an empty manifest. All columns of the input
are kept; columns named ``shard`` or ``arrival`` are replaced. A single text beyond
the target is a shard above it. DataFrame operations only.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.scratch import Scratch

#: Rows of the manifest that are broadcast at most.
BROADCAST_ROWS = 200_000
MANIFEST = "shard string, tier int, seq long, n_docs long, n_bytes long, path string"


class ShardStore:
    """Shards under ``root/data`` and manifests under ``root/manifest``."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        folder = self._path(f"{self.root}/manifest")
        if not self.fs.exists(folder):
            return 0
        return max(self._versions(), default=0)

    def _versions(self) -> list[int]:
        names = [str(x.getPath().getName()) for x in self.fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(x[1:]) for x in names if x[:1] == "v" and x[1:].isdigit())

    def _rows(self, version: int) -> str:
        """The folder with the manifest rows of a version."""
        f = self.fs.open(self._path(f"{self.root}/manifest/v{version}"))
        try:
            return f"{self.root}/rows/{f.readUTF()}"
        finally:
            f.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(self._rows(v))

    def commit(self, rows: DataFrame, version: int) -> int:
        """Publish ``rows`` as ``version``; raises if somebody else has published it."""
        name = uuid.uuid4().hex
        rows.selectExpr(*[f"cast({c} as {t}) {c}" for c, t in (x.strip().split() for x in MANIFEST.split(","))]).write.parquet(f"{self.root}/rows/{name}")
        self.fs.mkdirs(self._path(f"{self.root}/manifest"))
        pending, final = (self._path(f"{self.root}/{x}") for x in (f"pending-{name}", f"manifest/v{version}"))
        f = self.fs.create(pending, False)
        f.writeUTF(name)
        f.close()
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            # of a file, whole already, onto a name that must not exist
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(pending, final, none)
        except Exception as e:
            self.fs.delete(pending, False)
            raise RuntimeError(f"version {version} of {self.root} is published already") from e
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """Documents of a version with their ``shard``."""
        m = self.manifest(version).select("shard", "path")
        paths = [r.path for r in m.select("path").distinct().collect()]
        if not paths:
            none = self._path(f"{self.root}/schema")
            return self.spark.read.parquet(f"{self.root}/schema") if self.fs.exists(none) else self.spark.createDataFrame([], "shard string")
        return self._few(self._data(paths), m.select("shard"), "left_semi")

    @staticmethod
    def _few(data: DataFrame, shards: DataFrame, how: str = "inner") -> DataFrame:
        """Joined by shard; one row of 50 bytes a shard is broadcast up to 10 MB, and shuffled beyond."""
        return data.join(F.broadcast(shards) if shards.count() <= BROADCAST_ROWS else shards, "shard", how)

    def vacuum(self, retain: int = 2, grace_s: float = 86_400) -> None:
        """Delete versions before the last ``retain``, and data that no version left names, if older than ``grace_s`` seconds."""
        kept = self._versions()[-retain:] if self.version() else []
        for v in self._versions() if kept else []:
            if v not in kept:
                self.fs.delete(self._path(f"{self.root}/manifest/v{v}"), False)
        rows = {self._rows(v).rsplit("/", 1)[-1] for v in kept}
        live = {"data": {r.path for v in kept for r in self.manifest(v).select("path").distinct().collect()}, "rows": rows}
        for folder, names in live.items():
            at = self._path(f"{self.root}/{folder}")
            for x in self.fs.listStatus(at) if self.fs.exists(at) else []:
                if str(x.getPath().getName()) not in names and x.getModificationTime() <= (time.time() - grace_s) * 1000:
                    self.fs.delete(x.getPath(), True)

    def append(self, docs: DataFrame, arrival_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Write arrivals as tier-0 shards and commit them beside what is live."""
        v = self.version() + 1
        old = self.manifest(v - 1)
        size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
        seen = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
        n = max(1, -(-int(seen.b) // arrival_bytes))
        key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
        seq = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") % F.lit(n)
        rows = docs.drop("shard", "arrival").withColumn("arrival", seq)
        rows = rows.repartition(F.col("arrival")).withColumn("shard", F.format_string(f"v{v}-%06d", "arrival"))
        if not seen.n and not self.version():
            # no shard will hold the columns
            rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/schema")
        path = f"v{v}-{uuid.uuid4().hex[:12]}"
        rows.write.option("compression", "zstd").partitionBy("shard").parquet(f"{self.root}/data/{path}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.root}/data/{path}")
        made = written.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum(size).alias("n_bytes"), F.min("arrival").alias("seq"))
        made = made.withColumn("tier", F.lit(0)).withColumn("path", F.lit(path))
        base = old.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("s")).first().s
        return self.commit(old.select("shard", "tier", "seq", "n_docs", "n_bytes", "path").unionByName(made.withColumn("seq", F.col("seq") + base)), v)

    def _data(self, paths: list[str]) -> DataFrame:
        """Rows of some versions' folders; a column that a version lacks is null there."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.spark.read.parquet(f"{self.root}/data/{p}") for p in sorted(paths)])

    def plan(self, target_bytes: int, arrival_bytes: int) -> DataFrame:
        """``shard`` and the ``run`` that it is merged into, with its number of shards."""
        m = self.manifest().where(f"n_bytes < {target_bytes}")
        tier = F.floor(F.log(4.0, F.greatest(F.col("n_bytes"), F.lit(1)) / F.lit(float(arrival_bytes)))).cast("int")
        t = m.withColumn("size_tier", F.greatest(tier, F.lit(-1)))
        before = F.sum("n_bytes").over(W.partitionBy("size_tier").orderBy("seq", "shard").rowsBetween(W.unboundedPreceding, -1))
        t = t.withColumn("cut", F.floor(F.coalesce(before, F.lit(0)) / F.lit(target_bytes)))
        return t.withColumn("members", F.count("*").over(W.partitionBy("size_tier", "cut"))).withColumn("first", F.min("seq").over(W.partitionBy("size_tier", "cut")))

    def compact(self, target_bytes: int, arrival_bytes: int, text_col: str = "text") -> int:
        v = self.version() + 1
        plan = self.plan(target_bytes, arrival_bytes).where("members > 1")
        old = self.manifest()
        if plan.isEmpty():
            return v - 1
        runs = plan.select("shard", F.format_string(f"v{v}-%d-%06d", "size_tier", "cut").alias("run"), "path", "seq")
        data = self._data([r.path for r in runs.select("path").distinct().collect()])
        merged = self._few(data, runs.select("shard", "run")).drop("shard").withColumnRenamed("run", "shard")
        path = f"v{v}-{uuid.uuid4().hex[:12]}"
        # a task for each run, each of which is one file of the target's size
        merged.repartition(runs.select("run").distinct().count(), F.col("shard")).write.option("compression", "zstd").partitionBy("shard").parquet(f"{self.root}/data/{path}")
        size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
        made = self._data([path]).groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum(size).alias("n_bytes"))
        made = made.join(runs.groupBy(F.col("run").alias("shard")).agg(F.min("seq").alias("seq")), "shard").withColumn("tier", F.lit(1)).withColumn("path", F.lit(path))
        stay = old.join(runs.select("shard"), "shard", "left_anti")
        return self.commit(stay.select("shard", "tier", "seq", "n_docs", "n_bytes", "path").unionByName(made), v)


def shard(docs: DataFrame, target_bytes: int = 16 << 20, arrival_bytes: int = 2 << 20, root: str | None = None) -> ShardStore:
    """Append ``docs`` as arrivals, compact, drop what was replaced; the store at its new version.

    In a folder of this call's own nobody reads the version before, so it goes at once.
    """
    s = Scratch(docs.sparkSession, "shards")
    store = ShardStore(docs.sparkSession, root or s.root)
    store.append(docs, arrival_bytes)
    s.sweep()
    store.compact(target_bytes, arrival_bytes)
    store.vacuum(*((1, 0) if root is None else ()))
    return store
