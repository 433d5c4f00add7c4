"""Session helpers: the shared folder, written intermediate tables, table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, from ``spark.checkpoint.dir``.

    Only a single-process local session may go without that setting; it then
    gets a temporary folder. Anything else without it is an error, since a
    machine-local folder would not be visible to the other executors.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = conf or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="viewlake-")
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def local_path(shared: str) -> str:
    """The plain path of a shared folder that is mounted as one, for programs that write plain files; ValueError for any other."""
    if "://" in shared and not shared.startswith("file://") or not shared.startswith(("file:", "/")):
        raise ValueError(f"{shared} is no plain folder")
    return "/" + shared.removeprefix("file:").lstrip("/")


_WRITTEN: list = []


class Scratch:
    """Intermediate tables written to the shared folder, which cut lineage.

    A written table outlives any executor, so a later stage never has to
    recompute an iteration that is done. Tables are removed by ``drop`` as soon
    as a successor exists; what is left goes with ``clear`` or when the JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        path = self._path(self.base)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)  # only what exists can be marked for deletion
        self._fs.deleteOnExit(path)
        _WRITTEN.append((self._fs, path))

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def write_observed(self, df: DataFrame, name: str, measures: dict[str, Column]) -> tuple[DataFrame, dict]:
        """The written table and aggregates of its rows, taken by the job that writes it."""
        told = Observation()
        return self.write(df.observe(told, *(c.alias(n) for n, c in measures.items())), name), told.get

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.base}/{name}"), True)


def clear() -> None:
    """Delete all intermediate tables of this process. Results not yet read or written elsewhere are lost with them; for sessions that run many queries."""
    while _WRITTEN:
        fs, path = _WRITTEN.pop()
        fs.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; a plain file or a folder of part files."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    Only input of fewer files than cores is dealt out anew, for work that is dear per
    row; anything larger keeps the partitions of its scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
