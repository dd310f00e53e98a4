"""Prompt text and request payloads."""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom import rules
from copyloom.functions import text as tx

SLOT = re.compile(r"\{\{(\w+)\}\}")


def rule_texts() -> dict[str, str]:
    """What the slots for rules in a template stand for: the values that the checks use too."""
    banned = {f"banned_{kind.replace('-', '_')}": ", ".join(words) for kind, words in rules.BANNED_WORDS.items()}
    return banned | {
        "banned_opener": rules.BANNED_OPENER,
        "banned_first_phrases": ", ".join(f'"{p}"' for p in rules.BANNED_FIRST_PHRASES),
        "max_keyword_uses": str(rules.MAX_KEYWORD_USES),
        "max_keyword_bold": str(rules.MAX_KEYWORD_BOLD),
        "keyword_range": f"{rules.MIN_KEYWORDS}–{rules.MAX_KEYWORDS}",
        "faq_range": f"{rules.MIN_FAQ}–{rules.MAX_FAQ}",
        "answer_range": f"{rules.MIN_ANSWER_WORDS}–{rules.MAX_ANSWER_WORDS}",
    }


def default_template() -> str:
    """The default prompt with the rules filled in; the other slots are left."""
    text = resources.files("copyloom").joinpath("prompt_template.md").read_text("utf-8")
    known = rule_texts()
    return SLOT.sub(lambda m: known.get(m[1], m[0]), text)


def slots() -> dict[str, Column]:
    """What each `{{name}}` in a template stands for."""
    empty = F.array().cast("array<string>")
    competitors = F.coalesce("competitor_urls", empty)
    products = F.coalesce("product_links", empty)
    plain = {
        name: F.coalesce(name, F.lit(""))
        for name in (
            "brand_name", "website_url", "collection_url", "collection_topic",
            "target_market", "keywords",
        )
    }
    return plain | {
        "output_language": F.coalesce("output_language", F.lit(rules.DEFAULT_LANGUAGE)),
        "brand_info": tx.or_default(F.col("brand_info"), rules.NOT_GIVEN),
        "competitor_info": tx.joined_or(competitors, rules.NO_COMPETITORS),
        "product_info": tx.joined_or(products, rules.NOT_GIVEN),
        "competitor_list": F.array_join(competitors, ","),
    }


def render(template: str, values: dict[str, Column]) -> Column:
    """Template text with its slots filled, as one concatenation.

    Values are never searched for slots themselves.
    """
    pieces = SLOT.split(template)
    unknown = set(pieces[1::2]) - set(values)
    if unknown:
        raise ValueError(f"unknown slots: {sorted(unknown)}")
    parts = [F.lit(p) if i % 2 == 0 else values[p] for i, p in enumerate(pieces) if p]
    return F.concat(*parts)


def prompts(
    requests: DataFrame,
    template: str | None = None,
    contexts: DataFrame | None = None,
) -> DataFrame:
    """`request_id, prompt`; the context is put behind the prompt only if given."""
    text = render(template if template is not None else default_template(), slots())
    out = requests.select("request_id", text.alias("prompt"))
    if contexts is None:
        return out
    return out.join(contexts, "request_id", "left").select(
        "request_id", F.concat("prompt", F.coalesce("context", F.lit(""))).alias("prompt")
    )


def request_json(prompt: Column) -> Column:
    """Payload of a generation request."""
    message = F.struct(
        F.lit("user").alias("role"),
        F.array(F.struct(prompt.alias("text"))).alias("parts"),
    )
    config = F.struct(
        F.lit(rules.TEMPERATURE).alias("temperature"),
        F.lit(rules.MAX_OUTPUT_TOKENS).alias("maxOutputTokens"),
        F.lit(rules.TOP_P).alias("topP"),
    )
    return F.to_json(F.struct(F.array(message).alias("contents"), config.alias("generationConfig")))
