"""Readers with fixed schemas: page snapshots, requests, stream lines, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copyloom import schemas
from copyloom.operators.history import parse_history


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType = schemas.PAGES) -> DataFrame:
    """Stored pages; large pages are best read with small Arrow batches
    (`spark.sql.execution.arrow.maxRecordsPerBatch`)."""
    return spark.read.schema(schema).parquet(path)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Listing pages written by `write_listing`; a filter on `page_no` leaves out other folders."""
    return spark.read.schema(schemas.LISTING_PAGES).parquet(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """One JSON request per line; a damaged line gives NULL fields."""
    return spark.read.schema(schemas.REQUESTS).json(path)


def requests_from_json(df: DataFrame, body: Column) -> DataFrame:
    """Requests out of a JSON text column."""
    return df.select(F.from_json(body, schemas.REQUESTS).alias("_r")).select("_r.*")


def read_line_stream(
    spark: SparkSession, path: str, schema: T.StructType = schemas.ANSWER_LINES, kind: str = "json", **options
) -> DataFrame:
    """Stream of files that arrive in a folder."""
    return spark.readStream.schema(schema).options(**options).format(kind).load(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Stored history texts (one JSON list per file) → one row per record."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.inline(parse_history(F.col("value"))))
