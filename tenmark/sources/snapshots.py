"""Document snapshots as version folders: a point in time is a pinned version.

A version is written beside the others and counts once its marker file is there, so a lost job leaves nothing
that a reader sees. Documents are partitioned by cluster and index, as every read goes to one of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(docs: DataFrame, folder: str, version: int) -> None:
    docs.write.partitionBy("cluster", "index").parquet(f"{folder}/v={version}")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path(folder)):
        return []
    found = [s.getPath() for s in files.listStatus(path(folder)) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in found if files.exists(path(p, "_SUCCESS")))


def open_point(spark: SparkSession, folder: str) -> int:
    """Pins the latest version; a search that carries it sees no later write."""
    found = versions(spark, folder)
    if not found:
        raise LookupError("no version is complete")
    return found[-1]


def read_at(spark: SparkSession, folder: str, version: int, cluster: str | None = None, index: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/v={version}")
    for name, value in (("cluster", cluster), ("index", index)):
        docs = docs if value is None else docs.filter(F.col(name) == value)
    return docs
