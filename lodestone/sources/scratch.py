"""Written tables that cut the lineage of iterations, in the folder the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where the session sets none a temporary one on a local
    master, and an error on a cluster, whose machines do not share it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lodestone.scratch", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("lodestone.scratch", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
