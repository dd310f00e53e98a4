"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copyloom.plans.workdir import new_path

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder; the folder may be in any store that Spark reads."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: it is made once and outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, which need not have it installed.

    The archive is made beside the driver, once per application, and handed out
    by Spark like any file of `--py-files`.
    """
    context = spark.sparkContext
    if any(f.endswith("copyloom-code.zip") for f in context._python_includes):
        return
    root = Path(__file__).resolve().parents[2]
    path = os.path.join(tempfile.mkdtemp(prefix="copyloom-code-"), "copyloom-code.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted((root / "copyloom").rglob("*.py")):
            archive.write(file, str(file.relative_to(root)))
    context.addPyFile(path)


def give_back() -> None:
    """Hand memory that a Python worker has no more use for to the system; called at the end of a task.

    Workers live on, and the next operator's tasks would start on top of it.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with as many underscores before it as make it none of the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, _UPPER, _UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that no model learns from."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % 3
    return F.coalesce(fold == 1, F.lit(False))


def share(seed: int, *columns: Column) -> Column:
    """A fixed pseudo-random number from 0 to 1 of the given values."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / float(1 << 40)
