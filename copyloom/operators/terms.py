"""Whole-word uses of long lists of terms: runs of words of the texts meet the terms in an equi-join.

Each text is cut into words and the gaps between them once. A term is looked up
by the run from its first to its last word, gaps included, so the work on a text
does not grow with the list. For a short, fixed list `quality.word_counts` is
the plainer way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.operators.quality import LETTER

WORD = f"{LETTER}+"

#: Terms that may be broadcast: their number, and their bytes. More are joined by shuffle.
BROADCAST_TERMS = 500_000
BROADCAST_BYTES = 64 << 20

def _gaps(low: Column) -> Column:
    """What stands before, between and behind the words: one more than there are words."""
    return F.split(low, WORD, -1)


def _runs(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """All runs of as many words as `sizes` say: `id, gram`, the gaps `before` and `after`, and whether they open or close the text.

    The words and gaps that follow a place are columns next to it, so that all
    else is plain arithmetic on rows.
    """
    cut = texts.where("text is not null").select("id", F.lower("text").alias("_low")).select(
        "id", F.regexp_extract_all("_low", F.lit(WORD), 0).alias("_words"), _gaps(F.col("_low")).alias("_gaps")
    )
    most, count = max(sizes), F.size("_words")
    shifted = [F.slice("_words", k + 1, count).alias(f"w{k}") for k in range(most + 1)]
    shifted += [F.slice("_gaps", k + 1, count).alias(f"g{k}") for k in range(most + 1)]
    at = cut.select("id", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "at"))

    def run(n: int) -> Column:
        parts = [F.col("at.w0")]
        for j in range(1, n):
            parts += [F.col(f"at.g{j}"), F.col(f"at.w{j}")]
        return F.struct(
            F.concat(*parts).alias("gram"),
            F.col("at.g0").alias("before"),
            F.col(f"at.g{n}").alias("after"),
            (F.col("pos") == 0).alias("opens"),
            F.col(f"at.w{n}").isNull().alias("closes"),
        )

    return at.select("id", F.inline(F.array(*[run(n) for n in sizes]))).where("gram is not null")


def term_index(terms: DataFrame) -> DataFrame:
    """`term` → distinct lower-cased `term, gram, lead, tail, n_words`; `lead` and `tail` are signs round its words."""
    low = terms.select(F.lower("term").alias("term")).distinct()
    cut = low.select(
        "term", F.regexp_extract_all("term", F.lit(WORD), 0).alias("_words"), _gaps(F.col("term")).alias("_gaps")
    ).where(F.size("_words") > 0)
    lead, tail = F.get("_gaps", F.lit(0)), F.get("_gaps", F.size("_words"))
    inner = F.length("term") - F.length(lead) - F.length(tail)
    return cut.select(
        "term",
        F.col("term").substr(F.length(lead) + 1, inner).alias("gram"),
        lead.alias("lead"),
        tail.alias("tail"),
        F.size("_words").alias("n_words"),
    )


def term_uses(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """`id, text` and `term` → `id, term, n`: how often each term stands in each text, not inside longer words.

    Letters are lower-cased on both sides; gaps inside a term count as they are.
    Every place counts, also where two overlap. Terms that occur nowhere in a text
    give no row for it; null terms, and terms without a letter or digit, none at
    all. Repeated terms count as one; rows that share an id are summed.
    """
    index = term_index(terms)
    held = index.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length("term") + F.octet_length("gram")).alias("bytes"),
        F.sort_array(F.collect_set("n_words")).alias("sizes"),
    ).first()
    # As many kinds of runs as there are lengths of terms, whatever their number; one where there are none.
    places = _runs(texts, list(held["sizes"]) or [1]).withColumn("_n", F.lit(1).cast("long"))
    small = held["n"] <= BROADCAST_TERMS and (held["bytes"] or 0) <= BROADCAST_BYTES
    if small:
        index = F.broadcast(index)
    else:
        # Reduced before the shuffle; a run that is frequent is one row a text.
        same = ["id", "gram", "before", "after", "opens", "closes"]
        places = places.groupBy(*same).agg(F.sum("_n").alias("_n"))

    def stands(gap: Column, sign: Column, inside: Column, edge: Column) -> Column:
        # Signs that fill a gap between two words would have a letter next to them.
        return inside & ((sign == "") | edge | (F.length(gap) > F.length(sign)))

    met = places.join(index, "gram").where(
        stands(F.col("before"), F.col("lead"), F.col("before").endswith(F.col("lead")), F.col("opens"))
        & stands(F.col("after"), F.col("tail"), F.col("after").startswith(F.col("tail")), F.col("closes"))
    )
    return met.groupBy("id", "term").agg(F.sum("_n").alias("n"))
