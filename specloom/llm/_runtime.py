"""Shared folder and written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship as ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset and driver and executors are one process (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


#: A written table of at most so many bytes is sent to all executors in a join; a larger one is joined by sorting.
BESIDE_BYTES = 8 << 20


def beside(written: DataFrame, size: int) -> DataFrame:
    """A written table with its join strategy, by its counted size in bytes: no plan depends on estimates."""
    return written.hint("broadcast" if size <= BESIDE_BYTES else "merge")


class Workspace:
    """Named tables in the shared folder. They cut lineage: after a lost executor, Spark rereads them instead of recomputing.

    Tables that the returned result still reads stay until the application's folder is cleared; the others are dropped early.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        ship(spark)
        self.spark, self.root, self._n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_stored_at", None):
                self.remove(path)

    def remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
