"""Numbered listing pages: frontier, first-seen rule, stop rule, sequence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from copyloom import rules
from copyloom.functions import urls
from copyloom.operators.links import links_of
from copyloom.operators.pages import read_pages
from copyloom.plans.skew import numbered
from copyloom.plans.workdir import new_path


def frontier(collections: DataFrame, max_pages: int = rules.MAX_LISTING_PAGES) -> DataFrame:
    """`collection_url, platform` → the addresses of its pages 1..max_pages."""
    return collections.select(
        "collection_url",
        "platform",
        F.explode(F.sequence(F.lit(1), F.lit(max_pages))).alias("page_no"),
    ).withColumn(
        "page_url", urls.page_url(F.col("collection_url"), F.col("page_no"), F.col("platform"))
    )


def listing_links(
    listing: DataFrame, max_pages: int = rules.MAX_LISTING_PAGES, strict: bool = False
) -> DataFrame:
    """Listing snapshot → `collection_url, page_no, empty, has_next, links`.

    The platform is that of the collection's page 1. It is told beside the
    parse, which is stored with the anchors and the scopes of all platforms, so
    html is read once and never shuffled.
    """
    read = _parsed(listing.where(F.col("page_no").between(1, max_pages)))
    return _links_by_platform(read.drop("platform"), _platforms(read), strict)


def _parsed(wanted: DataFrame) -> DataFrame:
    """Listing pages with their anchors, stored; `platform` on page 1 only."""
    platform = F.when(
        F.col("page_no") == 1, urls.detect_platform(F.col("collection_url"), F.coalesce("html", F.lit("")))
    )
    parsed = read_pages(
        wanted.select(
            "collection_url",
            "page_no",
            (F.coalesce("html", F.lit("")) == "").alias("empty"),
            "has_next",
            platform.alias("platform"),
            "html",
        ),
        facts=False,
        base="collection_url",
    ).select("collection_url", "page_no", "empty", "has_next", "platform", "anchors")
    return _stored(parsed, "listing")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _platforms(read: DataFrame) -> DataFrame:
    return read.where("platform is not null").groupBy("collection_url").agg(F.min("platform").alias("_platform"))


def _links_by_platform(read: DataFrame, platforms: DataFrame, strict: bool) -> DataFrame:
    return read.join(platforms, "collection_url", "left").select(
        "collection_url",
        "page_no",
        "empty",
        "has_next",
        links_of(F.col("anchors"), F.coalesce("_platform", F.lit("unknown")), strict).alias("links"),
    )


def first_seen(links: DataFrame) -> DataFrame:
    """Each link of a collection once, at its first page and place there.

    `collection_url, page_no, ordinal, link` in and out; aggregated before the
    shuffle, so a link repeated on every page costs one row per task. Page and
    place (both INT) are packed into one number, which hash aggregation can hold.
    """
    place = F.shiftleft(F.col("page_no").cast("long"), 32) + F.col("ordinal")
    return (
        links.groupBy("collection_url", "link")
        .agg(F.min(place).alias("_at"))
        .select(
            "collection_url",
            F.shiftright("_at", 32).cast("int").alias("page_no"),
            F.col("_at").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("ordinal"),
            "link",
        )
    )


def new_per_page(first: DataFrame) -> DataFrame:
    return first.groupBy("collection_url", "page_no").agg(F.count(F.lit(1)).alias("new_links"))


def stop_page(
    pages: DataFrame,
    news: DataFrame,
    max_pages: int = rules.MAX_LISTING_PAGES,
    clicked: bool = False,
    starts: DataFrame | None = None,
) -> DataFrame:
    """First page that is not kept, per collection, and why.

    `pages`: `collection_url, page_no, empty, n_links, has_next`, one row per
    page; `news`: pages with at least one new link. A page can only be the
    stop page when it is page 1 or follows a page with news, so those are the
    candidates; no list of all page numbers is needed. With `clicked`, paging
    also ends behind a page without a next control, and an empty page counts
    as one without links. `starts` (`collection_url, page_no`) names where paging
    goes on, if not at page 1 of each collection.
    """
    if starts is None:
        starts = pages.select("collection_url").distinct().withColumn("page_no", F.lit(1))
    follow = news.select("collection_url", (F.col("page_no") + 1).alias("page_no"))
    stop = (
        starts.unionByName(follow)
        .join(news, ["collection_url", "page_no"], "left_anti")
        .groupBy("collection_url")
        .agg(F.min("page_no").alias("stop_page"))
    )
    at_stop = stop.join(
        pages.select(
            "collection_url",
            F.col("page_no").alias("stop_page"),
            F.col("empty").alias("_empty"),
            F.col("n_links").alias("_links"),
        ),
        ["collection_url", "stop_page"],
        "left",
    )
    reason = F.when(F.col("stop_page") > max_pages, "max_pages")
    if not clicked:
        reason = reason.when(F.coalesce("_empty", F.lit(True)), "empty")
    reason = reason.when(F.coalesce("_links", F.lit(0)) == 0, "no_links").otherwise("no_new")
    out = at_stop.select("collection_url", "stop_page", reason.alias("stop_reason"))
    if not clicked:
        return out
    ends = (
        pages.where(~F.coalesce("has_next", F.lit(False)))
        .groupBy("collection_url")
        .agg((F.min("page_no") + 1).alias("_end"))
    )
    ended = F.col("_end") <= F.col("stop_page")
    return out.join(ends, "collection_url", "left").select(
        "collection_url",
        F.when(ended, F.col("_end")).otherwise(F.col("stop_page")).alias("stop_page"),
        F.when(ended, "no_next").otherwise(F.col("stop_reason")).alias("stop_reason"),
    )


def paged_links(
    links: DataFrame,
    pages: DataFrame,
    max_pages: int = rules.MAX_LISTING_PAGES,
    clicked: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The links paging would have collected, and the stop table.

    `links`: `collection_url, page_no, ordinal, link`; `pages` as in
    `stop_page`. Reads pages behind the stop page too, but they cannot change
    which links are new before it.
    """
    within = F.col("page_no").between(1, max_pages)
    first = first_seen(links.where(within))
    stops = stop_page(pages.where(within), new_per_page(first), max_pages, clicked)
    kept = first.join(stops.select("collection_url", "stop_page"), "collection_url")
    return kept.where(F.col("page_no") < F.col("stop_page")).drop("stop_page"), stops


def page_totals(kept: DataFrame) -> DataFrame:
    """New and running total of links per kept page.

    The running sum sees one row per page, at most `max_pages` per collection.
    """
    running = Window.partitionBy("collection_url").orderBy("page_no").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return new_per_page(kept).withColumn("total_links", F.sum("new_links").over(running))


def with_sequence(kept: DataFrame) -> DataFrame:
    """1-based sequence of the links of each collection."""
    return numbered(kept, ["collection_url"], ["page_no", "ordinal", "link"])


def total_links(kept: DataFrame) -> DataFrame:
    return kept.groupBy("collection_url").agg(F.count(F.lit(1)).alias("n_links"))


def first_rows(numbered_links: DataFrame, order: list[str], n: int = rules.PREVIEW_ROWS) -> DataFrame:
    return numbered_links.orderBy(*order).limit(n)


def crawl(
    listing: DataFrame,
    max_pages: int = rules.MAX_LISTING_PAGES,
    clicked: bool = False,
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Listing snapshot → links per collection and stop table.

    The parse of each page is stored, so html is read once only.
    """
    return paged_links(*_by_link_and_page(listing_links(listing, max_pages, strict)), max_pages, clicked)


def _by_link_and_page(per_page: DataFrame) -> tuple[DataFrame, DataFrame]:
    long = per_page.select(
        "collection_url", "page_no", F.posexplode("links").alias("_pos", "link")
    ).select("collection_url", "page_no", (F.col("_pos") + 1).alias("ordinal"), "link")
    pages = per_page.select(
        "collection_url", "page_no", "empty", "has_next", F.size("links").alias("n_links")
    )
    return long, pages


@dataclass
class Crawl:
    """Links that paging collects, where and why it stops, and the pages that were read for it."""

    links: DataFrame
    stops: DataFrame
    read: DataFrame


#: Pages of a collection that are read at a time.
WAVE = 4
#: Open collections that may be broadcast to the pages of a wave.
BROADCAST_ROWS = 500_000


def crawl_in_waves(
    listing: DataFrame,
    max_pages: int = rules.MAX_LISTING_PAGES,
    clicked: bool = False,
    strict: bool = False,
    wave: int = WAVE,
) -> Crawl:
    """As `crawl`, but pages are only read while their collection is open.

    Pages 1 to `wave` of all collections are read first; what is new on them and
    which collections go on is stored, and the next pages are read of those
    alone, so that none more than a wave behind a stop is parsed. There are
    `max_pages / wave` waves at most. Where the listing is stored by page number
    (`write_listing`), a wave reads only its own files. Open collections are
    joined before the page job: broadcast up to `BROADCAST_ROWS`, and beyond by
    shuffle, in which case html of the wave's pages moves.
    """
    if wave < 1:
        raise ValueError("a wave has one page at least")
    known = listing.where(F.col("page_no").between(1, max_pages)).select("collection_url").distinct()
    still_open = _stored(known, "open-collections")
    kept: list[DataFrame] = []
    stops: list[DataFrame] = []
    read: list[DataFrame] = []
    for low in range(1, max_pages + 1, wave):
        high = min(low + wave - 1, max_pages)
        wanted = listing.where(F.col("page_no").between(low, high))
        if low > 1:
            here = still_open.select("collection_url")
            wanted = wanted.join(
                F.broadcast(here) if here.count() <= BROADCAST_ROWS else here, "collection_url", "left_semi"
            )
        parsed = _parsed(wanted)
        read.append(parsed.select("collection_url", "page_no"))
        if low == 1:
            still_open = _stored(still_open.join(_platforms(parsed), "collection_url", "left"), "open-collections")
        long, pages = _by_link_and_page(_links_by_platform(parsed.drop("platform"), still_open, strict))
        first = first_seen(long)
        for earlier in kept:
            first = first.join(earlier.select("collection_url", "link"), ["collection_url", "link"], "left_anti")
        first = _stored(first, "wave-news")
        starts = still_open.select("collection_url", F.lit(low).alias("page_no"))
        ends = _stored(stop_page(pages, new_per_page(first), high, clicked, starts), "wave-stops")
        news = first.join(ends.select("collection_url", "stop_page"), "collection_url")
        kept.append(_stored(news.where(F.col("page_no") < F.col("stop_page")).drop("stop_page"), "wave-links"))
        goes_on = F.col("stop_reason") == "max_pages"
        if high == max_pages:
            stops.append(ends)
            break
        stops.append(ends.where(~goes_on))
        still_open = _stored(
            still_open.join(ends.where(goes_on).select("collection_url"), "collection_url", "left_semi"), "open-collections"
        )
        if still_open.isEmpty():
            break
    return Crawl(*(_all(parts) for parts in (kept, stops, read)))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
