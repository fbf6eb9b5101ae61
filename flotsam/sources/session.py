"""Reading tables and cutting lineage."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one temporary folder in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="flotsam-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that a partition of a small table takes.
PARTITION_ROWS = 200_000


class Scratch:
    """Tables of an operator's steps in the shared folder; their true sizes let Spark plan the joins that follow.

    A table that is written again under its name replaces the one before, which is then deleted.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.paths = spark, new_folder(spark, "flotsam-steps"), {}

    def table(self, name: str, df: DataFrame) -> DataFrame:
        path, old = f"{self.folder}/{name}-{uuid.uuid4().hex}", self.paths.get(name)
        df.write.parquet(path)
        self.paths[name] = path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def measured(self, name: str, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        """The table, and aggregates of its rows that are taken while it is written."""
        seen = Observation()
        df = self.table(name, df.observe(seen, *(c.alias(k) for k, c in measures.items())))
        return df, seen.get

    def counted(self, name: str, df: DataFrame) -> tuple[DataFrame, int]:
        df, seen = self.measured(name, df, n=F.count(F.lit(1)))
        return df, seen["n"]

    def last(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``cut`` of the outcome, in few partitions if it has few ``rows``; the tables of the steps go."""
        df = cut(df)
        self._delete(self.folder)
        return df if rows is None else df.coalesce(1 + rows // PARTITION_ROWS)

    def delete(self, folder: str | None = None) -> None:
        """Removes all step tables, or another folder."""
        self._delete(folder or self.folder)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a session whose search path lacks it, once a session."""
    root = Path(__file__).resolve().parent.parent.parent
    context = spark.sparkContext
    reach = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == root for p in reach) or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="flotsam-package-")
    context.addPyFile(shutil.make_archive(f"{folder}/flotsam", "zip", root, "flotsam"))


#: Applications that have the package.
_SHIPPED: set[str] = set()
