"""Folders every executor can reach, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset (tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held.rstrip("/")
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="barloom-shared-")
        atexit.register(shutil.rmtree, found[len("file://"):], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scratch:
    """Parquet tables of one run, in the shared folder.

    ``put`` writes a frame and returns it reread, so that a lost executor costs a reread and no
    recomputation.  ``drop`` deletes what no later step reads; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/barloom/{name}-{uuid.uuid4().hex}"
        self.names: dict[str, None] = {}
        atexit.register(self.drop)

    def put(self, name: str, df: DataFrame, **options: object) -> DataFrame:
        at = f"{self.path}/{name}"
        self.names[name] = None
        df.write.mode("overwrite").options(**options).parquet(at)
        return self.spark.read.parquet(at)

    def drop_but(self, *kept: str) -> None:
        """Deletes all tables of this run but those named."""
        self.drop(*(n for n in self.names if n not in kept))

    def drop(self, *names: str) -> None:
        for n in names:
            self.names.pop(n, None)
        try:
            jvm = self.spark._jvm
            for at in [f"{self.path}/{n}" for n in names] or [self.path]:
                to = jvm.org.apache.hadoop.fs.Path(at)
                to.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(to, True)
        except Exception:  # the session is gone: nothing reads the tables any more
            if not names and self.path.startswith("file:/"):
                shutil.rmtree("/" + self.path[5:].lstrip("/"), ignore_errors=True)
