"""Writers: link lists, request payloads, history versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.operators.prompt import request_json

# Fixed value: header of the sequence column in link files.
SEQUENCE_HEADER = "序号"


def write_links(links: DataFrame, path: str) -> bool:
    """Numbered links (`seq, link`) as CSV files with header, in order; nothing when empty."""
    if links.isEmpty():
        return False
    (
        links.select(F.col("seq").alias(SEQUENCE_HEADER), F.col("link").alias("product_url"))
        .repartitionByRange(SEQUENCE_HEADER)
        .sortWithinPartitions(SEQUENCE_HEADER)
        .write.option("header", True)
        .mode("errorifexists")
        .csv(path)
    )
    return True


def write_listing(listing: DataFrame, path: str) -> None:
    """Listing pages in a folder per page number, so that paging reads those it gets to."""
    listing.write.mode("errorifexists").partitionBy("page_no").parquet(path)


def write_requests(prompts: DataFrame, path: str) -> None:
    """Prompts as generation payloads, one JSON object per line with its request id."""
    body = request_json(F.col("prompt")).alias("body")
    prompts.select("request_id", body).write.mode("errorifexists").json(path)


def write_history(history: DataFrame, folder: str) -> str:
    """The whole list as a new version in a fresh sub-folder, whose path is returned.

    Never overwrites the version it may be reading from.
    """
    path = f"{folder.rstrip('/')}/version-{uuid.uuid4().hex}"
    history.write.mode("overwrite").parquet(path)
    return path
