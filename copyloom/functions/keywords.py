"""Keyword columns: counts, merges and pool additions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from copyloom import rules
from copyloom.functions.text import comma_list, comma_or_line_list, let, strip

_EMPTY = "array<string>"


def pool(column: Column) -> Column:
    """A missing pool is an empty one."""
    return F.coalesce(column, F.array().cast(_EMPTY))


def pool_size(column: Column) -> Column:
    return F.size(pool(column)).cast("long")


def keyword_count(typed: Column) -> Column:
    return F.size(comma_list(typed)).cast("long")


def keyword_band(count: Column) -> Column:
    return (
        F.when(count < rules.MIN_KEYWORDS, f"under {rules.MIN_KEYWORDS}")
        .when(count > rules.MAX_KEYWORDS, f"over {rules.MAX_KEYWORDS}")
        .otherwise(f"{rules.MIN_KEYWORDS}-{rules.MAX_KEYWORDS}")
    )


def merge(existing: Column, selected: Column) -> Column:
    """Current keywords, then selected ones; first occurrence stays."""
    return F.array_distinct(F.concat(pool(existing), pool(selected)))


def new_keywords(pool_column: Column, typed: Column) -> Column:
    """Typed keywords that the pool lacks; repeats within the typed text stay."""
    return let(
        pool(pool_column),
        lambda known: F.filter(comma_or_line_list(typed), lambda k: ~F.array_contains(known, k)),
    )


def add_typed(pool_column: Column, typed: Column) -> Column:
    """Pool with typed keywords appended."""
    return F.concat(pool(pool_column), new_keywords(pool_column, typed))


def add_single(pool_column: Column, keyword: Column) -> Column:
    """Pool with one keyword appended, unless blank or present."""
    word = strip(keyword)
    refuse = word.isNull() | (word == "") | F.array_contains(pool(pool_column), word)
    return F.when(refuse, pool(pool_column)).otherwise(
        F.concat(pool(pool_column), F.array(word))
    )
