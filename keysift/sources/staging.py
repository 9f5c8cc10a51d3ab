"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a local session, in which driver and executor are one process, may do without: it gets a
    temporary folder.  On a cluster a missing setting is an error, since executors see no local folder
    of one another.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="keysift-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Staging:
    """Tables written once to the shared folder and read back, so that a lost executor costs no recomputation.

    Reading back prunes columns and gives the planner real sizes.  ``drop`` removes tables that nothing
    reads any more; what a returned frame still reads stays.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back."""
    return Staging(df.sparkSession, "stage").write(df, "rows")


def materialized_together(*frames: DataFrame) -> list[DataFrame]:
    """``materialized`` for several frames at once: their jobs run side by side, so none waits for another's last tasks."""
    with ThreadPoolExecutor(len(frames)) as pool:
        waiting = [pool.submit(inheritable_thread_target(df.sparkSession)(materialized), df) for df in frames]
        return [x.result() for x in waiting]
