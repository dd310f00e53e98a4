"""Answer columns: stream lines, whole answers, sections of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from copyloom import rules
from copyloom.functions.text import WS, blank_to_null, strip


def line_payload(line: Column) -> Column:
    """JSON part of a stream line; NULL for other lines and the end line."""
    payload = strip(F.substring(line, len(rules.LINE_PREFIX) + 1, 2**31 - 1))
    return F.when(line.startswith(rules.LINE_PREFIX), F.nullif(payload, F.lit(rules.END_LINE)))


def chunk_text(line: Column) -> Column:
    """Text carried by a stream line; NULL when there is none or the JSON is damaged."""
    return blank_to_null(F.get_json_object(line_payload(line), rules.ANSWER_TEXT_PATH))


def relay_event(line: Column) -> Column:
    """`struct<type, text, message>` of a relay line; type is NULL for any other line."""
    payload = F.when(line.startswith(rules.LINE_PREFIX), F.substring(line, len(rules.LINE_PREFIX) + 1, 2**31 - 1))
    event = F.from_json(payload, "type string, text string, message string")
    return F.when(event["type"].isin(*rules.RELAY_TYPES), event)


def relay_line(kind: Column, text: Column, message: Column) -> Column:
    """Relay line of an event, ended by a blank line; fields that are NULL are left out."""
    body = F.to_json(F.struct(kind.alias("type"), text.alias("text"), message.alias("message")))
    return F.concat(F.lit(rules.LINE_PREFIX), body, F.lit("\n\n"))


def answer_text(body: Column) -> Column:
    """Text of a whole (not streamed) answer, '' when missing."""
    return F.coalesce(F.get_json_object(body, rules.ANSWER_TEXT_PATH), F.lit(""))


def _heading(*words: str) -> str:
    return "##" + WS + "*" + (WS + "*").join(words)


def _between(text: Column, start: str, *ends: str) -> Column:
    stop = "|".join([*ends, r"\z"])
    found = F.regexp_extract(text, f"(?is)({start}.*?)(?={stop})", 1)
    return blank_to_null(strip(found))


def page_section(text: Column) -> Column:
    """The page copy: up to the Chinese part; the whole text when it has no heading."""
    found = _between(
        text, _heading("📝", rules.PAGE_COPY_HEADING), _heading("📝", rules.CHINESE_HEADING)
    )
    return F.coalesce(found, text)


def chinese_section(text: Column) -> Column:
    """The Chinese part: up to sources or checklist; '' when missing."""
    found = _between(
        text, _heading("📝", rules.CHINESE_HEADING), _heading("📚"), _heading("✅")
    )
    return F.coalesce(found, F.lit(""))


def between_markers(text: Column, start: str, *ends: str) -> Column:
    """Text from a literal marker up to the first of the end markers; NULL if absent."""
    quoted = [r"\Q" + e + r"\E" for e in ends]
    return _between(text, r"\Q" + start + r"\E", *quoted)
