"""History in versions: every change is a new list, named by a numbered log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from copyloom.operators import history as hist
from copyloom.sources import commit_log
from copyloom.sources.sinks import write_history


def newest(spark: SparkSession, folder: str) -> int:
    """The number of the newest version; 0 before the first."""
    return max((n for n, e in commit_log.entries(spark, folder).items() if e), default=0)


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The list of a version, the newest one if none is given."""
    log = commit_log.entries(spark, folder)
    number = max((n for n, e in log.items() if e), default=0) if version is None else version
    if not log.get(number):
        raise LookupError(f"{folder} has no version {number}")
    return spark.read.parquet(log[number]["path"])


def save(history: DataFrame, folder: str, based_on: int, batch: str | None = None) -> int:
    """A list as the next version; gives its number.

    `based_on` is the version that the list was made of. If another one has been
    saved since, `Conflict` is raised and nothing is changed. A `batch` that has
    been saved before does nothing.
    """
    spark = history.sparkSession
    log = commit_log.entries(spark, folder)
    done = next((n for n, e in log.items() if batch is not None and e.get("batch") == batch), None)
    if done is not None:
        return done
    if based_on != max((n for n, e in log.items() if e), default=0):
        raise commit_log.Conflict(f"{folder} has a newer version than {based_on}")
    number = max(log, default=0) + 1
    commit_log.commit(spark, folder, number, {"path": write_history(history, folder), "batch": batch})
    return number


def put(records: DataFrame, folder: str, batch: str | None = None, tries: int = 5) -> int:
    """Records put into the newest version as the next one; repeated on the newer list if another writer was first."""
    spark = records.sparkSession
    for _ in range(tries):
        base = newest(spark, folder)
        if base:
            whole = hist.upsert(read_version(spark, folder, base), records)
        else:
            none = records.withColumn("first_saved", F.col("version")).limit(0)
            whole = hist.upsert(none, records)
        try:
            return save(whole, folder, base, batch)
        except commit_log.Conflict:
            continue
    raise commit_log.Conflict(f"{folder}: other writers were first {tries} times")


def put_stream(records: DataFrame, folder: str, checkpoint: str, name: str = "history") -> DataStreamWriter:
    """A stream of records put in batch by batch; a batch that is repeated after a failure changes nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            put(rows, folder, f"{name}-{number}")

    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
