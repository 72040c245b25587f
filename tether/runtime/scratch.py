"""Durable intermediate tables.

Iterative operators cut their lineage by writing a Parquet table to the folder that all executors share
(``spark.checkpoint.dir``) and reading it back, so a lost executor costs only the tasks that ran on it.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "file://" + tempfile.gettempdir() + "/tether-scratch"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tether-scratch"


class Scratch:
    """Writes DataFrames as tables under one folder; what was not dropped goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_root(spark)}/tether-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is None:
            return
        try:
            self._delete(self.path)
        except Exception:  # the JVM may be gone before us
            pass

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def settle(self) -> None:
        """Lets go of the shuffle files of tables that are written by now; Spark frees them when it collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()
