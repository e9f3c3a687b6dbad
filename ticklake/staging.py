"""Tables that one run writes to the shared folder: they cut lineage, outlive executors, and go when the run ends."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The URI in spark.checkpoint.dir. In one process (local mode) an unset one becomes a temporary folder; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ticklake-"))
        base = spark.sparkContext.getCheckpointDir()
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}"
    return base.rstrip("/")


class Run:
    """A run's folder: put() writes a table and reads it again, drop() deletes one of them or, at the end, all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str | None = None) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
