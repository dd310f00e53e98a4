"""Text columns: white space, lists, defaults, escapes, snippets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from copyloom import rules

# White space as browsers see it: Java's \s is ASCII only, \p{Z} adds the
# Unicode blanks, and U+FEFF counts too.
WS = r"[\s\p{Z}\x{FEFF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row.

    Catalyst may copy an expression into a lambda, which would compute it again
    for every element; a lambda's own variable is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column) -> Column:
    """Turn each run of white space into one blank and trim the ends."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def strip(text: Column) -> Column:
    """Trim white space of any kind from both ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def body_text(raw: Column, limit: int = rules.MAX_BODY_CHARS) -> Column:
    """Squeezed body text, cut after `limit` characters (code points)."""
    return F.substring(squeeze(raw), 1, limit)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def or_default(text: Column, default: str | Column) -> Column:
    """`text`, or `default` where it is NULL or empty."""
    other = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(blank_to_null(text), other)


def _parts(text: Column, pattern: str) -> Column:
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), pattern), strip)
    return F.filter(trimmed, lambda x: x != "")


def comma_list(text: Column) -> Column:
    """Keywords as typed in the form: split on commas, trimmed, no blanks."""
    return _parts(text, ",")


def comma_or_line_list(text: Column) -> Column:
    """Keywords as typed into the pool: split on commas and line breaks."""
    return _parts(text, "[,\n]")


def line_list(text: Column) -> Column:
    """One entry per line, trimmed, no blanks."""
    return _parts(text, "\n")


def non_blank(items: Column) -> Column:
    """Trimmed array entries without the blank ones, order kept."""
    empty = F.array().cast("array<string>")
    return F.filter(F.transform(F.coalesce(items, empty), strip), lambda x: x != "")


def joined_or(items: Column, default: str) -> Column:
    """Entries joined by ', ', or a default sentence for an empty list."""
    return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(F.lit(default))


def numbered_lines(items: Column) -> Column:
    """`1. a\\n2. b\\n`, with a line break after each entry."""
    return F.array_join(
        F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n"))),
        "",
    )


def language_flag(language: Column) -> Column:
    flags = F.create_map(*[F.lit(v) for kv in rules.LANGUAGE_FLAGS.items() for v in kv])
    return F.coalesce(F.element_at(flags, language), F.lit(rules.OTHER_FLAG))


def escape_html(text: Column) -> Column:
    out = text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def escape_attr(text: Column) -> Column:
    out = F.replace(text, F.lit('"'), F.lit("&quot;"))
    return F.replace(out, F.lit("'"), F.lit("&#39;"))


def tidy_snippet(html: Column) -> Column:
    """Rendered HTML → shop snippet: no h1, blocks on lines of their own."""
    out = F.regexp_replace(html, r"(?i)<h1[^>]*>.*?</h1>", "")
    for tag in ("h2", "h3"):
        out = F.replace(out, F.lit(f"<{tag}>"), F.lit(f"\n<{tag}>"))
    for tag in ("h2", "h3", "p", "ul", "ol"):
        out = F.replace(out, F.lit(f"</{tag}>"), F.lit(f"</{tag}>\n"))
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def override_text(content: Column) -> Column:
    """Hand-typed replacement, trimmed; blank means none."""
    return blank_to_null(strip(content))


def utc_day(ts: Column) -> Column:
    """Day of a timestamp; the session time zone must be UTC."""
    return F.to_date(ts)
