"""Tables written to the shared folder, to cut lineage so that lost executors cost little.

A written table survives any executor; later stages reread it instead of
recomputing what led to it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a local master."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not (conf.get("spark.master", "") or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _local
    if _local is None:
        _local = tempfile.mkdtemp(prefix="spark-mediaspan-")
    return f"file://{_local}"


_local: str | None = None


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def written(spark: SparkSession, folder: str, label: str) -> list[int]:
    """The numbers N of the completely written tables `label=N` in a folder, ascending."""
    files, place = _at(spark, folder)
    if not files.exists(place):
        return []
    found = [s.getPath() for s in files.listStatus(place) if s.getPath().getName().startswith(f"{label}=")]
    return sorted(int(p.getName().partition("=")[2]) for p in found if files.exists(_at(spark, f"{p.toString()}/_SUCCESS")[1]))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing will read again; it may be gone already."""
    files, place = _at(spark, path)
    files.delete(place, True)


class Workspace:
    """A folder of written tables that belong to one run of one operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the written table."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        for name in names:
            remove(self.spark, self.path(name))
