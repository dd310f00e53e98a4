"""Requests joined with page facts: bundles, products, status, failures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom import rules
from copyloom.operators.requests import request_parts
from copyloom.plans.skew import numbered

FACT_COLUMNS = ["title", "meta_desc", "h1", "body_text", "product_links"]
BUNDLE_COLUMNS = ["request_id", "role", "role_no", "ordinal", "url", "success", "error", *FACT_COLUMNS]


def facts_by_url(facts: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row of facts per address, that of the lowest `page_id` (unique).

    The winner is found by its two keys alone. Give the `pages` that the facts
    come from, to read the keys there instead of parsing twice.
    """
    keys = (facts if pages is None else pages).select(F.col("url").alias("_url"), F.col("page_id").alias("_id"))
    first = keys.groupBy("_url").agg(F.min("_id").alias("_id"))
    return facts.join(
        first, F.col("url").eqNullSafe(F.col("_url")) & (F.col("page_id") == F.col("_id")), "left_semi"
    )


def attach_facts(parts: DataFrame, facts: DataFrame) -> DataFrame:
    """Left join on the address; a page outside the snapshot becomes a failure row.

    `facts` must be unique on `url`. Adaptive execution splits a popular address.
    """
    wanted = facts.select("url", F.col("success").alias("_ok"), "error", *FACT_COLUMNS)
    joined = parts.join(wanted, "url", "left")
    return joined.select(
        "request_id",
        "role",
        "role_no",
        "ordinal",
        "url",
        F.coalesce("_ok", F.lit(False)).alias("success"),
        F.when(F.col("_ok").isNull(), F.lit("not in snapshot")).otherwise(F.col("error")).alias("error"),
        *FACT_COLUMNS,
    )


def product_parts(bundle: DataFrame, requests: DataFrame, limit: int = rules.MAX_PRODUCTS) -> DataFrame:
    """Product pages of each collection that was read: its first `limit` links.

    The list is cut before it is exploded. Requests with `skip_products` and
    collections without links give nothing.
    """
    asked = requests.where(~F.coalesce("skip_products", F.lit(False))).select("request_id")
    # Empty lists give no rows when exploded. Asking for their size would have the optimizer
    # infer the same of the requests, which fails where links are made by a lambda.
    collections = bundle.where((F.col("role") == "collection") & F.col("success"))
    return (
        collections.join(asked, "request_id", "left_semi")
        .select("request_id", F.posexplode(F.slice("product_links", 1, limit)).alias("_pos", "url"))
        .select(
            "request_id",
            F.lit("product").alias("role"),
            F.lit(rules.ROLE_NO["product"]).alias("role_no"),
            (F.col("_pos") + 1).alias("ordinal"),
            "url",
        )
    )


def request_bundle(
    requests: DataFrame,
    facts: DataFrame | str,
    limit: int = rules.MAX_PRODUCTS,
    attach: Callable[[DataFrame, DataFrame | str], DataFrame] = attach_facts,
) -> DataFrame:
    """Everything a request asks for, long: brand, collection, products, competitors.

    `facts` should be a stored table: it is read once for the named pages and
    once for the products. With `fact_store.attached` as `attach` it is the
    folder of a store, whose texts are not shuffled.
    """
    named = attach(request_parts(requests), facts)
    products = attach(product_parts(named, requests, limit), facts)
    return named.unionByName(products)


def fetch_status(bundle: DataFrame) -> DataFrame:
    """Pages read and asked for per request and role; 'ok' only when all were read."""
    counts = bundle.groupBy("request_id", "role").agg(
        F.count_if("success").alias("ok"), F.count(F.lit(1)).alias("total")
    )
    return counts.withColumn(
        "status", F.when(F.col("ok") == F.col("total"), "ok").otherwise("fail")
    )


def failed_queue(bundle: DataFrame) -> DataFrame:
    """Failed pages of each request in the order they are to be replaced by hand."""
    failed = bundle.where(~F.col("success")).select("request_id", "role", "role_no", "ordinal", "url")
    return numbered(failed, ["request_id"], ["role_no", "ordinal", "url"], "queue_no").select(
        "request_id", "queue_no", F.col("role").alias("type"), "url"
    )
