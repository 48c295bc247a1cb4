"""Intermediate tables that outlive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"file://{tempfile.mkdtemp(prefix='docflow-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    _delete_at_exit(spark, own)
    return own


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


class Workspace:
    """Parquet tables under one folder of the shared directory; they go when the driver's JVM ends, or by ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _delete_at_exit(spark, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        """``df`` computed once and read back: later plans start from the files, not from its lineage."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._docflow_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no later plan reads."""
        for table in tables:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(table._docflow_path)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def checkpoint(self, df: DataFrame) -> DataFrame:
        """A reliable checkpoint, which unlike ``save`` keeps partitions and the order of rows in them."""
        context = self.spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(shared_dir(self.spark))
        return df.checkpoint(eager=True)
