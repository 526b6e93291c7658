"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import LacunaError


class Scratch:
    """Tables written below the session's ``spark.checkpoint.dir``.

    Where that is unset, a local session, as in tests, gets a local folder; on a
    cluster it is an error, as other machines would not see it.  A saved table cuts
    the lineage, survives the loss of any executor, and knows its size, so that
    the planner can choose joins by it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise LacunaError("set spark.checkpoint.dir to a folder that all machines share")
            base = tempfile.mkdtemp(prefix="lacuna-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.base = f"{base}/lacuna-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str = "t", tidy: bool = True) -> DataFrame:
        """Writes ``df`` and returns the stored rows.

        What its plan shuffled is of no more use then; a collection in the JVM
        lets Spark delete those files now and not at some later time.  Where a plan
        shuffles little, as small steps of a loop do, ``tidy=False`` saves that time.
        """
        self._n += 1
        path = f"{self.base}/{self._n}-{name}"
        df.write.parquet(path)
        if tidy:
            self.spark._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes saved tables that no later step reads."""
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
