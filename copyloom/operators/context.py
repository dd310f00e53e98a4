"""Page facts and hand-typed replacements → one ordered context text per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom import rules
from copyloom.functions import text as tx


def with_overrides(bundle: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds `override`, the replacement for a page that could not be read.

    Brand and collection replacements go by role, the others by role and
    address; of several for one place the one with the highest `version`
    counts, and a blank one takes the replacement back. A replacement for a
    brand that the request never named is kept as a row of its own; whether it
    counts is decided in `context`. The replacements of a request, as many as
    it has places, travel in one map, so pages are shuffled by request only.
    """
    by_role = F.col("role").isin("brand", "collection")
    slot = F.when(by_role, F.lit("")).otherwise(F.coalesce("url", F.lit("")))
    typed = (
        overrides.select("request_id", "role", slot.alias("_slot"), "version", tx.override_text(F.col("content")).alias("_text"))
        .groupBy("request_id", "role", "_slot")
        .agg(F.max_by(F.struct("_text"), "version")["_text"].alias("_text"))
        .where(F.col("_text").isNotNull())
    )
    place = F.struct("role", "_slot")
    by_request = typed.groupBy("request_id").agg(
        F.map_from_entries(F.collect_list(F.struct(place.alias("key"), F.col("_text").alias("value")))).alias("_typed")
    )
    pages = (
        bundle.withColumn("_slot", slot)
        .join(by_request, "request_id", "left")
        .withColumn("override", F.try_element_at("_typed", place))
        .withColumn("from_page", F.lit(True))
    )
    named = bundle.where(by_role).select("request_id", "role")
    alone = typed.where(by_role).join(named, ["request_id", "role"], "left_anti")
    kinds = {f.name: f.dataType for f in bundle.schema}
    made = {
        "role_no": F.when(F.col("role") == "brand", 1).otherwise(2),
        "ordinal": F.lit(1),
        "success": F.lit(False),
    }
    added = alone.select(
        *[
            F.col(c) if c in ("request_id", "role") else made.get(c, F.lit(None)).cast(kinds[c]).alias(c)
            for c in bundle.columns
        ],
        F.col("_text").alias("override"),
        F.lit(False).alias("from_page"),
    )
    both = pages.select(*bundle.columns, "override", "from_page").unionByName(added)
    return both.withColumn("success", F.coalesce("success", F.lit(False)))


def backfilled(bundle: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rows that have something to say: facts where read, else the replacement."""
    source = F.when(F.col("success"), "facts").when(F.col("override").isNotNull(), "override")
    return with_overrides(bundle, overrides).withColumn("source", source).where(
        F.col("source").isNotNull()
    )


def _line(label: str, value: str) -> Column:
    return F.concat(F.lit(label), F.coalesce(value, F.lit("")), F.lit("\n"))


def _facts_lines(*parts: tuple[str, str]) -> Column:
    return F.concat(*[_line(label, value) for label, value in parts])


def section() -> Column:
    """Context text of one row; '' where nothing is to be said.

    The first product and the first competitor carry the heading of their
    group, which therefore appears even when every item is dropped.
    """
    title = (rules.TITLE_LABEL, "title")
    meta = (rules.META_LABEL, "meta_desc")
    h1 = (rules.H1_LABEL, "h1")
    body = (rules.BODY_LABEL, "body_text")

    def single(heading: str, address: str) -> Column:
        read = F.concat(F.lit(f"\n\n## {heading}（"), F.coalesce(address, F.lit("")), F.lit("）\n"), _facts_lines(title, meta, body))
        typed = F.concat(F.lit(f"\n\n## {heading}（{rules.OVERRIDE_MARK}）\n"), F.col("override"), F.lit("\n"))
        return F.when(F.col("success"), read).when(F.col("override").isNotNull(), typed)

    def item(heading: str, name: str, *parts: tuple[str, str]) -> Column:
        number = F.col("ordinal").cast("string")
        address = F.coalesce("url", F.lit(""))
        read = F.concat(
            F.lit(f"\n### {name} "), number, F.lit("："), F.coalesce("title", F.lit("")),
            F.lit("（"), address, F.lit("）\n"), _facts_lines(*parts),
        )
        typed = F.concat(
            F.lit(f"\n### {name} "), number, F.lit(f"（{rules.OVERRIDE_MARK}，"), address,
            F.lit("）\n"), F.col("override"), F.lit("\n"),
        )
        text = F.when(F.col("success"), read).when(F.col("override").isNotNull(), typed)
        head = F.when(F.col("ordinal") == 1, F.lit(f"\n\n## {heading}\n")).otherwise("")
        return F.concat(head, F.coalesce(text, F.lit("")))

    role = F.col("role")
    out = (
        F.when(role == "brand", single(rules.BRAND_HEADING, "website_url"))
        .when(role == "collection", single(rules.COLLECTION_HEADING, "collection_url"))
        .when(role == "product", item(rules.PRODUCTS_HEADING, rules.PRODUCT_ITEM, meta, h1, body))
        .when(role == "competitor", item(rules.COMPETITORS_HEADING, rules.COMPETITOR_ITEM, body))
    )
    return F.coalesce(out, F.lit(""))


def typed_links_section(links: Column) -> Column:
    """Section with the product links typed into the form; '' for none."""
    before, after = rules.LINK_COUNT_LABEL.split("{n}")
    text = F.concat(
        F.lit(f"\n\n## {rules.TYPED_LINKS_HEADING}\n{before}"),
        F.size(links).cast("string"),
        F.lit(f"{after}\n"),
        tx.numbered_lines(links),
    )
    return F.when(F.size(links) > 0, text).otherwise("")


def context(requests: DataFrame, bundle: DataFrame, overrides: DataFrame) -> DataFrame:
    """`request_id, context` for every request.

    Replacements count only for requests with at least one page row: without
    scraped data they are ignored. The rows of a request come from the lists in
    its own row, so its text is put together in one step; the join and the
    aggregation share one partitioning.
    """
    rows = with_overrides(bundle, overrides).drop("error", "product_links")
    wanted = requests.select("request_id", "website_url", "collection_url", "product_links")
    placed = wanted.join(rows, "request_id", "left").select(
        "request_id", "product_links", "from_page", "role_no", "ordinal", section().alias("section")
    )
    texts = placed.groupBy("request_id").agg(
        F.expr("listagg(section, '') WITHIN GROUP (ORDER BY role_no, ordinal)").alias("_text"),
        F.bool_or("from_page").alias("_scraped"),
        F.any_value("product_links").alias("_links"),
    )
    links = F.coalesce("_links", F.array().cast("array<string>"))
    scraped = F.when(F.coalesce("_scraped", F.lit(False)), F.col("_text")).otherwise("")
    return texts.select(
        "request_id", F.concat(scraped, typed_links_section(links)).alias("context")
    )
