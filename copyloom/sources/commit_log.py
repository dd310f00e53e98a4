"""A numbered log of commits in a folder, each entry written only if its number is free.

An entry is a small JSON file; what it names has been written before it, under a
name of its own, so that work that was broken off is never seen. An entry counts
once its text is whole. There is one entry per commit, read on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer was first."""


def _place(spark: SparkSession, folder: str, name: str = ""):
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/_log/{name}")
    return path.getFileSystem(conf), path


def entries(spark: SparkSession, folder: str) -> dict[int, dict]:
    """The whole entries by number, the lowest first."""
    files, log = _place(spark, folder)
    if not files.exists(log):
        return {}
    found = {}
    for status in files.listStatus(log):
        number = status.getPath().getName().removesuffix(".json")
        if not number.isdigit():
            continue
        stream = files.open(status.getPath())
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            found[int(number)] = json.loads(text)
        except ValueError:  # being written, or broken off
            found[int(number)] = {}
    return dict(sorted(found.items()))


def commit(spark: SparkSession, folder: str, number: int, entry: dict) -> None:
    """Write an entry under a free number; `Conflict` if it is taken."""
    files, path = _place(spark, folder, f"{number:020d}.json")
    try:
        stream = files.create(path, False)
    except Exception as exc:
        if files.exists(path):
            raise Conflict(f"commit {number} of {folder} is taken") from exc
        raise
    try:
        stream.write(bytearray(json.dumps(entry).encode()))
    finally:
        stream.close()
