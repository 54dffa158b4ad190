"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def give_back() -> None:
    """Returns a worker's freed memory to the machine. A worker that has read large batches waits for
    its next task beside others, and Arrow and the C library keep what it has freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run):
    """The same task over batches, which gives its memory back at its end."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of a source for each bucket of whole texts; a bucket is one group in a Python task.
BUCKET_BYTES = 32 << 20


def buckets(docs: DataFrame) -> int:
    """How many buckets texts are dealt into: two for each shuffle partition, and more where the
    planner's size of the table says that these would hold too much."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # a source without statistics names a size beyond all tables
    return max(2 * partitions(docs.sparkSession), size // BUCKET_BYTES if size < 1 << 60 else 0)


def heavy(counts: DataFrame, n: int) -> DataFrame:
    """Rows of ``counts`` that stand for more than their share: c over 1000, and over one in 8 n of
    the sum of all c. Fewer than 8 n, whatever the input, so they are marked for a broadcast."""
    bound = counts.agg(F.expr(f"greatest(1000, sum(c) / {8 * n})").alias("bound"))
    return F.broadcast(counts.where(F.col("c") > 1000).join(F.broadcast(bound), F.col("c") > F.col("bound")).drop("bound"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one is
    made and set on a local master; on a cluster that would be lost with its machine, so it is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lodestone.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("lodestone.scratch", base)
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


class Scratch:
    """Tables written under the shared folder to cut lineage: each survives lost executors and is
    read again by the next step. ``drop`` removes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.names: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.names.append(name)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str = "") -> None:
        remove(self.spark, f"{self.root}/{name}".rstrip("/"))

    def keep_only(self, *names: str) -> None:
        for name in [n for n in self.names if n not in names]:
            self.drop(name)
            self.names.remove(name)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, th): just the two columns that the operators read, so that further columns
    and clashing names do no harm; a null text is empty; th tells rows with one id and different
    texts apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "th", F.xxhash64("doc_id", "text")
    )
