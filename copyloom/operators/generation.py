"""Answers in batch: decode stream lines, reassemble chunks, close generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom import rules
from copyloom.functions.answers import chunk_text, relay_event, relay_line
from copyloom.plans.skew import concat_in_order, salted_lookup


def decode_lines(lines: DataFrame) -> DataFrame:
    """`request_id, seq, line` → `request_id, seq, text`; works on streams too."""
    return lines.select("request_id", "seq", chunk_text(F.col("line")).alias("text")).where(
        F.col("text").isNotNull()
    )


def decode_relay(lines: DataFrame) -> DataFrame:
    """Relay lines → relay events; other and damaged lines are dropped. Works on streams too."""
    return (
        lines.select("request_id", "seq", relay_event(F.col("line")).alias("_e"))
        .select("request_id", "seq", "_e.type", "_e.text", "_e.message")
        .where(F.col("type").isNotNull())
    )


def encode_relay(events: DataFrame) -> DataFrame:
    """Relay events → the lines that carry them."""
    line = relay_line(F.col("type"), F.col("text"), F.col("message"))
    return events.select("request_id", "seq", line.alias("line"))


def join_fragments(fragments: DataFrame) -> DataFrame:
    """Raw arrivals → lines: `request_id, seq, fragment` → `request_id, seq, line`.

    The last, unfinished line is kept, if there is anything in it.
    """
    whole = concat_in_order(fragments, ["request_id"], "seq", "fragment")
    parts = F.split("fragment", "\n")
    lines = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return whole.select("request_id", F.posexplode(lines).alias("_pos", "line")).select(
        "request_id", F.col("_pos").cast("long").alias("seq"), "line"
    )


def reassemble(chunks: DataFrame) -> DataFrame:
    """Full text per request; a repeated `(request_id, seq)` counts once."""
    once = chunks.groupBy("request_id", "seq").agg(F.min("text").alias("text"))
    return concat_in_order(once, ["request_id"], "seq", "text").select(
        "request_id", F.col("n").alias("n_chunks"), "text"
    )


def close_generations(events: DataFrame, now: Column | None = None, timeout_ms: int = rules.GENERATION_TIMEOUT_MS) -> DataFrame:
    """Relay events → text, status and message per request.

    The end mark or error with the lowest `seq` ends a generation, at equal
    `seq` the error; chunks behind it are ignored. A generation with neither is
    still open, or timed out if `now` is given and the first of its events (by
    their column `at`, a timestamp) is `timeout_ms` or more before it.
    """
    rank = F.struct("seq", (F.col("type") != "error").alias("_rank"), "type", "message")
    ends = events.where(F.col("type").isin("done", "error")).groupBy("request_id").agg(
        F.min(rank).alias("_e")
    ).select("request_id", F.col("_e.seq").alias("_end"), F.col("_e.type").alias("_type"), F.col("_e.message").alias("message"))
    chunks = events.where(F.col("type") == "chunk").select("request_id", "seq", "text")
    kept = salted_lookup(
        chunks, ends.select("request_id", "_end"), "request_id", spread_by=["seq"]
    ).where(F.col("_end").isNull() | (F.col("seq") < F.col("_end")))
    texts = reassemble(kept)
    closed = texts.join(ends, "request_id", "full").select(
        "request_id",
        F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("_type", F.lit("open")).alias("status"),
        "message",
    )
    if now is None:
        return closed
    begun = events.groupBy("request_id").agg(F.min("at").alias("_begun"))
    millis = lambda t: F.unix_millis(t.cast("timestamp"))
    late = millis(now) - millis(F.col("_begun")) >= timeout_ms
    return closed.join(begun, "request_id").select(
        "request_id",
        "n_chunks",
        "text",
        F.when((F.col("status") == "open") & late, "timeout").otherwise(F.col("status")).alias("status"),
        "message",
    )
