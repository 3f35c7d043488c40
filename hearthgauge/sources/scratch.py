"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Setting of the session: whether an execution's shuffle files go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (tests on one machine), a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("hearthgauge.scratch.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='hearthgauge-')}"
        spark.conf.set("hearthgauge.scratch.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written once and reread: they cut lineage and survive the loss of any executor."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, lean: bool = False) -> DataFrame:
        """`df` as written. lean: packed tighter, and the shuffle files of the write go when it ends, not when the driver
        happens to collect its garbage; a `df` that is executed again deals its rows again."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(SHUFFLES_GO, "false")
        if lean:
            self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            df.write.mode("overwrite").options(**({"compression": "zstd"} if lean else {})).parquet(path)
        finally:
            if lean:
                self.spark.conf.set(SHUFFLES_GO, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
