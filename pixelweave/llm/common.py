"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; where that is unset, a temporary one on a local master, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own.setdefault("dir", tempfile.mkdtemp(prefix="spark-shared-"))
    return found.rstrip("/")


def store(df: DataFrame, tag: str, folder: str | None = None) -> str:
    """Write ``df`` once to the shared folder; its path there."""
    path = f"{folder or shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, tag))


def if_few(df: DataFrame, few: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if a count shows at most ``few`` (short) rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(few + 1).count() <= few else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
