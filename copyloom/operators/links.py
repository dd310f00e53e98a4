"""Product links: platform, container scope, predicate, canonical form, distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom import rules
from copyloom.functions import urls
from copyloom.operators.pages import read_pages
from copyloom.plans.skew import numbered


def _bit(platform: Column) -> Column:
    out = F
    for name, bit in rules.PLATFORM_BITS.items():
        out = out.when(platform == name, F.lit(bit))
    return out.otherwise(F.lit(0))


def links_of(anchors: Column, platform: Column, strict: bool = False) -> Column:
    """Distinct canonical product links of one page, in page order, as an array.

    A page's anchors lie in one row, so this needs no shuffle.
    """
    bit = _bit(platform)
    kept = F.filter(
        anchors,
        lambda a: a.link.isNotNull()
        & ((bit == 0) | (a.scopes.bitwiseAND(bit) != 0))
        & urls.platform_link(platform, a.href),
    )
    return F.array_distinct(
        F.transform(kept, lambda a: urls.canonical_for(platform, a.link, strict))
    )


def scope_used(found: Column, platform: Column) -> Column:
    """'container', or 'page' where the scan fell back to the whole page."""
    return F.when(found.bitwiseAND(_bit(platform)) != 0, "container").otherwise("page")


def extract_links(pages: DataFrame, strict: bool = False) -> DataFrame:
    """`page_id, url, html` → `page_id, url, platform, scope_used, links`."""
    platform = urls.detect_platform(F.col("url"), F.col("html"))
    read = read_pages(
        pages.select("page_id", "url", "html", platform.alias("platform")), facts=False
    )
    return read.select(
        "page_id",
        "url",
        "platform",
        scope_used(F.col("found"), F.col("platform")).alias("scope_used"),
        links_of(F.col("anchors"), F.col("platform"), strict).alias("links"),
    )


def page_anchors(pages: DataFrame) -> DataFrame:
    """Every anchor of every page: `page_id, url, ordinal, href, link`."""
    read = read_pages(pages.select("page_id", "url", "html"), facts=False)
    return read.select("page_id", "url", F.inline("anchors")).select(
        "page_id", "url", "ordinal", "href", "link"
    )


def distinct_links(pages: DataFrame, test, canonical: bool = True) -> DataFrame:
    """Distinct links per page for a caller-given href test, first occurrence first.

    `test` is a function from an href column to a boolean column. With
    `canonical` the query and trailing slashes are cut before comparing.
    """
    read = read_pages(pages.select("page_id", "url", "html"), facts=False)
    kept = F.filter("anchors", lambda a: a.link.isNotNull() & test(a.href))
    form = urls.canonical if canonical else (lambda c: c)
    links = F.array_distinct(F.transform(kept, lambda a: form(a.link)))
    return read.select("page_id", "url", links.alias("links"))


def explode_links(per_page: DataFrame, limit: int | None = None) -> DataFrame:
    """Array form → one row per link with its 1-based `ordinal`; first `limit` only if given."""
    links = F.slice("links", 1, limit) if limit else F.col("links")
    others = [c for c in per_page.columns if c != "links"]
    return per_page.select(*others, F.posexplode(links).alias("_pos", "link")).select(
        *others, (F.col("_pos") + 1).alias("ordinal"), "link"
    )


def distinct_overall(links: DataFrame, place: list[str]) -> DataFrame:
    """Each link once, at its first place (`place` = ordering columns)."""
    first = links.groupBy("link").agg(F.min(F.struct(*place)).alias("_at"))
    return first.select("link", *[F.col(f"_at.{p}").alias(p) for p in place])


def overall_sequence(links: DataFrame, place: list[str]) -> DataFrame:
    """Distinct links of the whole input with their 1-based sequence number."""
    return numbered(distinct_overall(links, place), [], [*place, "link"]).select("seq", "link")


def not_yet_known(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links that are not among the known ones; adaptive execution splits a link found very often."""
    return links.join(known.select("link"), "link", "left_anti")
