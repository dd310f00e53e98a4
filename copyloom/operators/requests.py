"""Writing requests: defaults, validation, and their parts as a long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom import rules
from copyloom.functions import text as tx


def form_values(raw: DataFrame) -> DataFrame:
    """Form text → request columns: trimmed fields, one list entry per line.

    `output_language` 'custom' takes `custom_language`, or the default.
    """
    single = (
        "brand_name", "website_url", "collection_url", "collection_topic",
        "target_market", "keywords", "brand_info",
    )
    chosen = F.when(
        F.col("output_language") == "custom",
        tx.or_default(tx.strip(F.col("custom_language")), rules.DEFAULT_LANGUAGE),
    ).otherwise(F.coalesce("output_language", F.lit(rules.DEFAULT_LANGUAGE)))
    return raw.select(
        "request_id",
        *[tx.strip(F.coalesce(c, F.lit(""))).alias(c) for c in single],
        tx.line_list(F.col("competitor_urls")).alias("competitor_urls"),
        tx.line_list(F.col("product_links")).alias("product_links"),
        chosen.alias("output_language"),
    )


def missing_fields(fields: list[str] | tuple[str, ...] = rules.REQUIRED_FIELDS) -> Column:
    """Names of the required fields that are NULL or empty, in form order."""
    return F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f))
                for f in fields
            ]
        )
    )


def validated(
    requests: DataFrame, fields: list[str] | tuple[str, ...] = rules.REQUIRED_FIELDS
) -> DataFrame:
    """Adds `missing` and `valid`."""
    return requests.withColumn("missing", missing_fields(fields)).withColumn(
        "valid", F.size("missing") == 0
    )


def has_address(url: Column) -> Column:
    return F.coalesce(url, F.lit("")) != ""


def split_by_address(requests: DataFrame, url: str = "collection_url") -> tuple[DataFrame, DataFrame]:
    """Accepted requests, and those rejected because their page address is missing."""
    ok = has_address(F.col(url))
    return requests.where(ok), requests.where(~ok)


def request_parts(requests: DataFrame) -> DataFrame:
    """One row per page a request asks for: `request_id, role, role_no, ordinal, url`.

    The parts of a request lie in its own row, so no shuffle is needed.
    Blank competitor addresses are dropped, the others are numbered from 1.
    """

    def one(role: str, url: Column) -> Column:
        return F.struct(
            F.lit(role).alias("role"),
            F.lit(rules.ROLE_NO[role]).alias("role_no"),
            F.lit(1).alias("ordinal"),
            url.alias("url"),
        )

    competitors = F.transform(
        tx.non_blank(F.col("competitor_urls")),
        lambda u, i: F.struct(
            F.lit("competitor").alias("role"),
            F.lit(rules.ROLE_NO["competitor"]).alias("role_no"),
            (i + 1).alias("ordinal"),
            u.alias("url"),
        ),
    )
    fixed = F.filter(
        F.array(one("brand", F.col("website_url")), one("collection", F.col("collection_url"))),
        lambda p: has_address(p.url),
    )
    accepted = requests.where(has_address(F.col("collection_url")))
    return accepted.select("request_id", F.inline(F.concat(fixed, competitors)))
