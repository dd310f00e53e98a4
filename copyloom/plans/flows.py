"""The three whole flows, as one call each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom import rules
from copyloom.functions import answers
from copyloom.operators import bundle as bundles
from copyloom.operators import context as contexts
from copyloom.operators import paging, prompt, quality
from copyloom.operators.pages import page_facts
from copyloom.operators.requests import validated
from copyloom.plans.workdir import new_path
from copyloom.sources import fact_store


@dataclass
class Gathered:
    """What is known about the requests after their pages were read."""

    bundle: DataFrame
    status: DataFrame
    failed: DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back, so that later steps do not redo it."""
    return df.sparkSession.read.schema(df.schema).parquet(write_new(df, name))


def write_new(df: DataFrame, name: str) -> str:
    """`df` as a new table in the shared folder; gives its path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def gather(requests: DataFrame, pages: DataFrame) -> Gathered:
    """Requests and a page snapshot → bundles, status per role, pages to replace by hand."""
    folder = new_path(pages.sparkSession, "facts")
    fact_store.write_facts(bundles.facts_by_url(page_facts(pages), pages), folder)
    bundle = stored(bundles.request_bundle(requests, folder, attach=fact_store.attached), "bundle")
    return Gathered(bundle, bundles.fetch_status(bundle), bundles.failed_queue(bundle))


def payloads(
    requests: DataFrame,
    bundle: DataFrame | None = None,
    overrides: DataFrame | None = None,
    include_context: bool = False,
    template: str | None = None,
) -> DataFrame:
    """Valid requests → `request_id, prompt, body`.

    The context is left out of the prompt unless `include_context` is set.
    """
    valid = validated(requests).where("valid")
    context = None
    if include_context and bundle is not None and overrides is not None:
        context = contexts.context(valid, bundle, overrides)
    out = prompt.prompts(valid, template, context)
    return out.withColumn("body", prompt.request_json(F.col("prompt")))


def finished(generations: DataFrame) -> DataFrame:
    """Generations → page copy and Chinese counterpart, with the whole answer."""
    return generations.where(F.col("status") == "done").select(
        "request_id",
        answers.page_section(F.col("text")).alias("page_copy"),
        answers.chinese_section(F.col("text")).alias("chinese_copy"),
        "text",
    )


def reviewed(
    sections: DataFrame, keywords: DataFrame, faq_title: str = rules.FAQ_HEADING
) -> DataFrame:
    """Copy checks over finished sections; `keywords`: `request_id, keywords` (array).

    Modules, sources and marks of doubt are checked in the whole answer, the
    rest in the page copy. `faq_title` is the FAQ heading in the copy's language.
    """
    texts = sections.join(keywords, "request_id", "left").select(
        F.col("request_id").alias("id"),
        F.col("page_copy").alias("text"),
        F.col("text").alias("whole"),
        "keywords",
    )
    return quality.check_texts(texts, faq_title=faq_title)


def collect_links(
    listing: DataFrame,
    max_pages: int = rules.MAX_LISTING_PAGES,
    clicked: bool = False,
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Listing snapshot → numbered links per collection (`collection_url, seq, link`), stop table."""
    kept, stops = paging.crawl(listing, max_pages, clicked, strict)
    numbered = paging.with_sequence(kept).select("collection_url", "seq", "link")
    return numbered, stops


def collect_links_in_waves(
    listing: DataFrame,
    max_pages: int = rules.MAX_LISTING_PAGES,
    clicked: bool = False,
    strict: bool = False,
    wave: int = paging.WAVE,
) -> tuple[DataFrame, DataFrame]:
    """The same as `collect_links`, reading pages of open collections only."""
    done = paging.crawl_in_waves(listing, max_pages, clicked, strict, wave)
    numbered = paging.with_sequence(done.links).select("collection_url", "seq", "link")
    return numbered, done.stops
