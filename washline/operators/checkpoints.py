"""Cutting lineage through the shared folder the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def is_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process; not so for ``local-cluster``."""
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a one-machine session without one gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not is_one_machine(spark):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="washline-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    """A name that no other run uses, below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/washline-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the reliable checkpoint folder and read it back."""
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The table as Parquet in a new folder below the shared one, for results that outlive the run."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
