"""The shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession) -> str:
    """Folder named by `spark.checkpoint.dir`, which driver and executors have to share."""
    context = spark.sparkContext
    active = context.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not (named or active):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if active is None:
        context.setCheckpointDir(named)
    return named or active


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table once nothing reads it any more."""
    if not path.startswith(f"{work_dir(spark).rstrip('/')}/"):
        raise ValueError(f"{path} is not in the shared folder")
    jvm, context = spark._jvm, spark.sparkContext
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
