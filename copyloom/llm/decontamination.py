"""Benchmark passages in training texts: a broadcast hash set of word windows, verified word by word.

Only DataFrame functions. A document's windows are hashed where its text is
read, looked up in the broadcast set, and compared with the window's words in
the same stage, so that nothing but hits, and one row per document, is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.llm.common import ascii_lower, fresh, stored

#: What is no word: ASCII but for digits and a-z, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Words in a window.
WINDOW = 10
#: Windows in one broadcast: about 200 MB at most. More are taken in several blocks.
BLOCK = 500_000
#: Contaminated documents that may be broadcast, with their spans.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _windows(words: Column, lengths: list[int]) -> Column:
    """All windows of these lengths: `pos` (from 1), `len`, `hash`."""

    def of(length: int) -> Column:
        hashed = lambda i: F.struct(
            i.alias("pos"), F.lit(length).alias("len"), F.xxhash64(F.slice(words, i, length)).alias("hash")
        )
        places = F.when(
            F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - (length - 1))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(places, hashed)

    return F.concat(*[of(n) for n in lengths]) if lengths else F.lit(None)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`item_id, text` → `hash, len, window, items`, one row per different window.

    An item with fewer words than a window, but not none, is one window. Items
    without an id count as hits, but are in no list of items.
    """
    split = benchmark.select("item_id", words(F.col("text")).alias("words")).where("size(words) > 0")
    length = F.least(F.lit(window), F.size("words"))
    places = split.withColumn("len", length).withColumn(
        "pos", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1))
    )
    return (
        places.withColumn("window", F.slice("words", F.col("pos"), F.col("len")))
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        .select(F.xxhash64("window").alias("hash"), F.size("window").alias("len"), "window", "items")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`doc_id, n_words, n_hit, spans, items, contaminated`, one row per row of `docs`.

    A word inside any occurrence of a window is hit; `spans` are the hit runs as
    `first, last` word numbers from 0; `items` the ids of all items with windows
    in the text. Null, empty and wordless texts have no hits; an empty benchmark
    hits nothing; other columns don't matter.
    """
    return _contamination(docs, benchmark, window).drop("row")


def _contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same, and `row`, the hash of the text."""
    known = stored(benchmark_windows(benchmark, window), "windows")
    lengths = [r[0] for r in known.select("len").distinct().orderBy("len").collect()]  # `window` at most
    blocks = max(1, math.ceil(known.count() / BLOCK))
    split = docs.select(
        "doc_id", F.xxhash64("text").alias("row"), words(F.col("text")).alias("words")
    )
    none = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("bigint").alias("hash")))
    hits = None
    for block in range(blocks):
        # The row at place 0 stands for the document itself, whether it has hits or not.
        places = F.concat(none, _windows(F.col("words"), lengths)) if lengths else none
        some = known.where(F.pmod("hash", F.lit(blocks)) == block).select(
            F.col("hash").alias("h"), F.col("len").alias("l"), "window", "items"
        )
        spread = split.select("doc_id", "row", "words", F.explode(places).alias("at"))
        met = spread.join(
            F.broadcast(some),
            (F.col("at.hash") == F.col("h"))
            & (F.col("at.len") == F.col("l"))
            & (F.slice("words", F.greatest(F.col("at.pos"), F.lit(1)), F.col("at.len")) == F.col("window")),
            "left",
        ).where("at.pos = 0 or items is not null")
        met = met.select(
            "doc_id",
            "row",
            F.when(F.col("at.pos") == 0, F.size("words")).cast("bigint").alias("n"),
            F.when(F.col("at.pos") > 0, F.struct("at.pos", "at.len")).alias("hit"),
            "items",
        )
        hits = met if hits is None else hits.unionByName(met.where("n is null"))
    gathered = hits.groupBy("row", "doc_id").agg(
        F.max("n").alias("n_words"),
        F.count("n").cast("int").alias("alike"),  # rows equal in doc_id and text
        F.sort_array(F.collect_set("hit")).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # Windows in order of their start; one that starts inside or right behind the last run extends it.
    runs = F.aggregate(
        "hits",
        F.array().cast("array<struct<first:int,last:int>>"),
        lambda runs, h: F.when(
            (F.size(runs) > 0) & (F.element_at(runs, -1)["last"] >= h["pos"] - 2),
            F.concat(
                F.slice(runs, 1, F.size(runs) - 1),
                F.array(
                    F.struct(
                        F.element_at(runs, -1)["first"].alias("first"),
                        F.greatest(F.element_at(runs, -1)["last"], h["pos"] + h["len"] - 2).alias("last"),
                    )
                ),
            ),
        ).otherwise(
            F.concat(
                runs,
                F.array(F.struct((h["pos"] - 1).alias("first"), (h["pos"] + h["len"] - 2).alias("last"))),
            )
        ),
    )
    counted = F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + F.lit(1)
    )
    return (
        gathered.withColumn("spans", runs)
        .withColumn("n_hit", counted)
        .withColumn("of_alike", F.explode(F.array_repeat(F.lit(0), F.col("alike"))))
        .select("doc_id", "row", "n_words", "n_hit", "spans", "items", (F.col("n_hit") > 0).alias("contaminated"))
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, spans: bool = False) -> DataFrame:
    """`docs` without contaminated documents, or with `spans` without their hit words.

    All columns stay as they are, but for the text with `spans`, in which each
    hit run of words goes with what stands between them. Each row is judged by
    its own text, also of rows that share a doc_id or have none.
    """
    bad_id, bad_row, hits = fresh(docs, "_bad_id", "_bad_row", "_spans")
    found = _contamination(docs, benchmark).where("contaminated")
    bad = found.groupBy(F.col("doc_id").alias(bad_id), F.col("row").alias(bad_row)).agg(F.first("spans").alias(hits))
    bad = stored(bad if spans else bad.select(bad_id, bad_row), "contaminated")
    small = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    same = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_row))
    if not spans:
        return docs.join(small, same, "left_anti")
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{_ANY_WORD}|{_ANY_BETWEEN}"), F.lit(0))
    # Words and what is between them alternate; the first piece decides which are which.
    shift = F.when(F.element_at(pieces, 1).rlike(_ANY_WORD), 0).otherwise(1)
    inside = lambda p, i: F.exists(
        hits, lambda s: ((i - shift) >= s["first"] * 2) & ((i - shift) <= s["last"] * 2)
    )
    cut = F.array_join(F.filter(pieces, lambda p, i: ~inside(p, i)), "")
    return docs.join(small, same, "left").select(
        *[
            F.when(F.col(hits).isNull(), F.col(c)).otherwise(cut).alias(c) if c == "text" else F.col(c)
            for c in docs.columns
        ]
    )


# The same words in a text whose capitals are still there.
_ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ANY_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
