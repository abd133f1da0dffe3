"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Characters that count as white space wherever a contract speaks of ``[\x20\x09-\x0D]``.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where the driver got it from ``sys.path`` alone."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    # Workers live on from stage to stage; so they give back the memory of large arrays when these go.
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(4 << 20))
    env.setdefault("MALLOC_TRIM_THRESHOLD_", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session may leave it unset; it then gets a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = Path(tempfile.mkdtemp(prefix="spark-llm-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", at)
    # With its scheme, so that workers who open files themselves look in the same store as Spark.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/(?!/)", "file:///", whole).rstrip("/")


class Scratch:
    """Tables written in the shared folder, so that a lost executor costs a reread and not a rerun."""

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self, *names: str) -> None:
        """Drops tables, and lets Spark's cleaner remove the shuffle files of plans that are done with."""
        self.drop(*names)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def passed(id_kind: DataType, rest: str) -> StructType:
    """A column ``id`` of any type, whatever the names of its fields, and the columns of ``rest``."""
    return StructType([StructField("id", id_kind), *StructType.fromDDL(rest)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def id_crc(c: Column, mod: int) -> Column:
    """crc32 of an id as text, modulo ``mod``."""
    return F.crc32(c.cast("string").cast("binary")) % mod
