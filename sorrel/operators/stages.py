"""Stages that are written once because several plans read them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a session in one process may have none; it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sorrel-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for sources that open files themselves, so the folder must be a mounted one."""
    folder = shared_folder(spark)
    if re.match(r"[a-z0-9]+:", folder) and not folder.startswith("file:"):
        raise ValueError(f"{folder} is not a folder that files can be opened in")
    return f"{re.sub('^file:(?://)?', '', folder)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder once, as Parquet, so that each reader takes only the columns that it needs."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
