"""What operators share: checkpoints in the folder that all executors see, names that no column has."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, on one machine alone (tests), a folder made for it. On a cluster that raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        made = context._jsc.sc().getCheckpointDir()
        if made.isEmpty():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='assaykit-')}")
            made = context._jsc.sc().getCheckpointDir()
        root = made.get()
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, made at once: rows keep their partitions and order."""
    spark = df.sparkSession
    root = shared_root(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def passing(spark: SparkSession, folder: str) -> str:
    """A folder that is there, to be deleted when the driver ends at the latest."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over as many tasks as a shuffle has at least: for costly work on each row of a small table, which is read in few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def filtered_here(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition), but for filters that must stay above the steps that make their columns.

    Pushed below a chain of steps, a filter would hold each step's expression as often as the next one
    refers to it, which doubles from step to step. Nothing is pushed below a column that isn't
    deterministic, so the filter reads one.
    """
    mark = fresh(df, "_mark")
    return df.withColumn(mark, F.rand(0)).where(condition & (F.col(mark) >= 0)).drop(mark)
