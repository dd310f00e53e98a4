"""Passages of several lines that occur again, by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines says where chunks end, so
that the same lines are cut alike wherever they stand. Chunks of several lines
that occur more than once, and are equal byte by byte, stay where they occur
first and go elsewhere. Only DataFrame functions.

Chunks miss what their boundaries cut off. `passage_dedup` has no boundaries: it
looks at every pair of neighbouring units (lines, or sentences of long lines) and
removes whole runs of repeated pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom.llm.common import fresh, stored

#: Lines that the rolling hash looks at; a chunk ends where it is 0 modulo `SPAN`.
ROLL, SPAN = 2, 2
#: Lines that a chunk needs to be removed.
LEAST_LINES = 2
#: Lines of more characters count as several, one for each sentence.
LONG_LINE = 160
#: A repeated run goes if it has more words than this, or `LEAST_LINES` whole lines.
MOST_WORDS = 50
#: Ends of sentences; they stay with the sentence.
SENTENCE_ENDS = (". ", "! ", "? ", "。", "！", "？")
#: Repeated chunks that may be broadcast, by their hashes.
BROADCAST_ROWS = 1_000_000


def lines(text: Column) -> Column:
    """The lines of a text, without their line breaks; null and empty have none."""
    return F.when(F.length(text) > 0, F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>"))


def chunk_ends(lines: Column, roll: int = ROLL, span: int = SPAN) -> Column:
    """Numbers of the lines (from 1) that end a chunk; the last one always does."""
    hashed = F.transform(lines, lambda x: F.xxhash64(x))

    def ends(i: Column) -> Column:
        # The window is full from line `roll` on; before it nothing ends.
        return (i >= roll) & (F.pmod(F.xxhash64(F.slice(hashed, i - (roll - 1), roll)), F.lit(span)) == 0)

    inner = F.when(
        F.size(lines) > roll, F.filter(F.sequence(F.lit(roll), F.size(lines) - 1), ends)
    ).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(lines) > 0, F.concat(inner, F.array(F.size(lines)))).otherwise(inner)


def chunks(docs: DataFrame) -> DataFrame:
    """`doc_id, row` (hash of the text), `chunk` (from 0), `n_lines, hash, body`, one row per chunk."""
    cut = docs.select(
        F.xxhash64("text").alias("row"), "doc_id", lines(F.col("text")).alias("lines")
    ).withColumn("ends", chunk_ends(F.col("lines")))
    spans = F.transform(
        "ends",
        lambda e, i: F.struct(
            (F.when(i > 0, F.try_element_at("ends", i)).otherwise(0) + 1).alias("first"), e.alias("last")
        ),
    )
    each = cut.select("row", "doc_id", "lines", F.posexplode(spans).alias("chunk", "at"))
    body = F.array_join(F.slice("lines", F.col("at.first"), F.col("at.last") - F.col("at.first") + 1), "\n")
    return each.select(
        "row", "doc_id", "chunk", (F.col("at.last") - F.col("at.first") + 1).alias("n_lines"), body.alias("body")
    ).withColumn("hash", _hash())


def _hash() -> Column:
    return F.xxhash64("body", "n_lines")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row", "chunk")


def repeated_chunks(docs: DataFrame, least_lines: int = LEAST_LINES) -> DataFrame:
    """`hash, body, n, kept`: chunks of several lines whose hash occurs more than once, and where they stay.

    Hashes are counted first, reduced where texts are read; only chunks whose
    hash occurs more than once are compared, by grouping them by their bytes.
    A hash that different chunks share has several rows, also of chunks that
    occur once (`n` = 1).
    """
    some = chunks(docs).where(F.col("n_lines") >= least_lines)
    twice = stored(
        some.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "chunk-hashes"
    )
    small = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    return (
        some.join(small, "hash", "left_semi")
        .groupBy("hash", "body")
        .agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("kept"))
    )


def line_dedup(docs: DataFrame, least_lines: int = LEAST_LINES) -> DataFrame:
    """All columns of `docs` (`doc_id, text`) with repeated chunks removed, and what was removed.

    Adds `n_lines`, `n_removed` (lines) and `removed` (chunk numbers). The first
    occurrence stays: that of the smallest doc_id (null last), of rows that share
    it that of the smallest text hash, and then the first in the text. Rows equal
    in doc_id and text are one document and end up alike. Null and empty texts
    stay as they are; a text all of whose lines go becomes empty. Columns of
    these names are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "removed")
    again = stored(repeated_chunks(docs, least_lines), "repeated-chunks")
    found = chunks(docs).where(F.col("n_lines") >= least_lines)
    # Where all chunks with a hash were found to be equal, the hash stands for the bytes.
    bodies = again.groupBy("hash").agg(F.count(F.lit(1)).alias("bodies"))
    alone = stored(
        again.where("n > 1").select("hash", "kept").join(bodies.where("bodies = 1"), "hash", "left_semi"), "chunks"
    )
    shared = again.join(bodies.where("bodies > 1"), "hash", "left_semi").where("n > 1").select("hash", "body", "kept")
    shared = stored(shared, "shared-hashes")
    small = F.broadcast(alone) if alone.count() <= BROADCAST_ROWS // 5 else alone
    met = found.select("doc_id", "row", "chunk", "hash").join(small, "hash").drop("hash")
    if shared.count():
        more = found.join(shared, ["hash", "body"]).select("doc_id", "row", "chunk", "kept")
        met = met.unionByName(more)
    gone = (
        met
        .where(_place() != F.col("kept"))
        .groupBy(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row"))
        .agg(F.sort_array(F.collect_set("chunk")).alias("_removed"))
    )
    gone = stored(gone, "removed-chunks")
    small = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS // 5 else gone
    same = F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.xxhash64("text") == F.col("_gone_row"))
    joined = docs.join(small, same, "left")
    removed = F.coalesce("_removed", F.array().cast("array<int>"))
    all_lines, ends = lines(F.col("text")), chunk_ends(F.col("_lines"))
    out = joined.withColumn("_lines", all_lines).withColumn(
        "_ends", F.when(F.size(removed) > 0, ends).otherwise(F.array().cast("array<int>"))
    )
    first = lambda c: F.when(c > 0, F.try_element_at("_ends", c)).otherwise(0)
    drop = F.transform(removed, lambda c: F.struct(first(c).alias("after"), F.element_at("_ends", c + 1).alias("upto")))
    out = out.withColumn("_drop", drop)
    kept = F.filter(
        "_lines", lambda x, i: ~F.exists("_drop", lambda d: (i >= d["after"]) & (i < d["upto"]))
    )
    cleaned = F.when(F.size("_drop") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    lost = F.aggregate("_drop", F.lit(0), lambda n, d: n + d["upto"] - d["after"])
    return out.select(
        *[cleaned.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.size("_lines").cast("bigint").alias("n_lines"),
        lost.cast("bigint").alias("n_removed"),
        removed.alias("removed"),
    )


def _parts(line: Column) -> Column:
    """A short line, or the sentences of a long one; nothing empty, but for an empty line."""

    def cut(ends: tuple[str, ...]) -> Column:
        # A line holds no line break, so one can mark the ends.
        marked = line
        for end in ends:
            marked = F.replace(marked, F.lit(end), F.lit(end + "\n"))
        return F.split(marked, "\n", -1)

    # To look for a sign costs far less than to replace it; few texts have the wide ones.
    wide = tuple(e for e in SENTENCE_ENDS if not e.isascii())
    any_wide = reduce(lambda x, y: x | y, [F.contains(line, F.lit(e)) for e in wide])
    parts = (
        F.when(F.length(line) <= LONG_LINE, F.array(line))
        .when(any_wide, cut(SENTENCE_ENDS))
        .otherwise(cut(tuple(e for e in SENTENCE_ENDS if e.isascii())))
    )
    return F.filter(parts, lambda p: (F.length(p) > 0) | (F.length(line) == 0))


def units(text: Column) -> Column:
    """What passages are made of: `pos` (from 0), `line`, `first`, `last` (of its line), `text`.

    Short lines, and the sentences of long ones; the cut depends on the line alone.
    """
    # An array of one element binds the parts, which would be cut again for each of them.
    of_line = lambda x, n: F.transform(
        F.array(_parts(x)),
        lambda found: F.transform(
            found,
            lambda p, i: F.struct(
                n.alias("line"), (i == 0).alias("first"), (i == F.size(found) - 1).alias("last"), p.alias("text")
            ),
        ),
    )
    each = F.flatten(F.flatten(F.transform(lines(text), of_line)))
    return F.transform(
        each,
        lambda u, i: F.struct(
            i.alias("pos"), u["line"].alias("line"), u["first"].alias("first"), u["last"].alias("last"), u["text"].alias("text")
        ),
    )


def _n_words(text: Column, other: Column | None = None) -> Column:
    """Words between blanks; `other` says whether the text may have blanks other than spaces."""
    spaced = text
    # A pattern of one character needs no regular expression, which would be compiled for each text.
    for space in "\t\n\x0b\f\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))

    def split(t: Column) -> Column:
        return F.size(F.array_remove(F.split(t, " ", -1), ""))

    if other is None:
        return split(spaced)
    # Between single spaces, words are one more than the spaces.
    bare = F.trim(text)
    spaces = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "), F.lit("")))
    single = F.when(F.octet_length(bare) > 0, spaces + 1).otherwise(0)
    return F.when(other, split(spaced)).when(F.contains(bare, F.lit("  ")), split(text)).otherwise(single)


def _other_blanks(text: Column) -> Column:
    """Whether the lines of a text have blanks other than spaces."""
    return reduce(lambda x, y: x | y, [F.contains(text, F.lit(c)) for c in "\t\x0b\f\r"])


def _window_hash(*values: Column) -> Column:
    return F.xxhash64(*values)


def window_hashes(docs: DataFrame) -> DataFrame:
    """`hash` of each row of `windows`, without what else a row holds."""
    # Trimmed once for both windows that a unit is in; a unit's words are the same without its last spaces.
    of_line = lambda x: F.transform(
        F.array(_parts(x)),
        lambda found: F.transform(
            found, lambda p, i: F.struct(F.rtrim(p).alias("text"), (i == F.size(found) - 1).alias("last"))
        ),
    )
    cut = docs.select(
        F.flatten(F.flatten(F.transform(lines(F.col("text")), of_line))).alias("units"),
        _other_blanks(F.col("text")).alias("other"),
    )
    single = F.transform(
        F.filter("units", lambda u: _is_long(u["text"], F.col("other"))), lambda u: _window_hash(u["text"])
    )
    rest = F.greatest(F.size("units") - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice("units", F.lit(1), rest),
        F.slice("units", F.lit(2), rest),
        lambda a, b: _window_hash(a["text"], b["text"], a["last"]),
    )
    return cut.select(F.explode(F.concat(pairs, single)).alias("hash"))


def _is_long(text: Column, other: Column) -> Column:
    """Whether a unit has words enough to go alone."""
    return F.when(F.length(text) > 2 * MOST_WORDS, _n_words(text, other) > MOST_WORDS).otherwise(False)


def windows(docs: DataFrame) -> DataFrame:
    """`doc_id, row, other, pos, hash, a, b`: each pair of neighbouring units, and each unit of over `MOST_WORDS` words.

    `b` is null for a single unit; `other` says whether the text has blanks other
    than spaces. Spaces behind a sentence don't count.
    """
    cut = docs.select(
        F.xxhash64("text").alias("row"),
        "doc_id",
        _other_blanks(F.col("text")).alias("other"),
        units(F.col("text")).alias("units"),
    )

    def pair(a: Column, b: Column) -> Column:
        hashed = _window_hash(F.rtrim(a["text"]), F.rtrim(b["text"]), a["last"])
        return F.struct(a["pos"].alias("pos"), hashed.alias("hash"), a.alias("a"), b.alias("b"))

    none = F.lit(None).cast("struct<pos:int,line:int,first:boolean,last:boolean,text:string>")
    long = F.filter("units", lambda u: _is_long(u["text"], F.col("other")))
    single = F.transform(
        long, lambda u: F.struct(u["pos"].alias("pos"), _window_hash(F.rtrim(u["text"])).alias("hash"), u.alias("a"), none.alias("b"))
    )
    rest = F.greatest(F.size("units") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("units", F.lit(1), rest), F.slice("units", F.lit(2), rest), pair)
    each = cut.select("row", "doc_id", "other", F.explode(F.concat(pairs, single)).alias("w"))
    return each.select("row", "doc_id", "other", "w.*")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """`doc_id, row, spans` (`first, last` unit): what goes of each document that loses something.

    Windows are counted by hash, reduced where texts are read; those whose hash
    occurs more than once are compared by grouping them by their bytes. Places are
    then found by the hash, but for hashes that different windows share.
    """
    every = windows(docs)
    twice = stored(
        window_hashes(docs).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "window-hashes"
    )
    small = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    # Between lines there is a line break, between sentences a space; a single unit has neither.
    body = F.concat(
        F.rtrim("a.text"),
        F.when(F.col("b").isNull(), "").otherwise(
            F.concat(F.when(F.col("a.last"), "\n").otherwise(" "), F.rtrim("b.text"))
        ),
    )

    def mark(unit: str) -> Column:
        # Units have even places and the links between them odd ones, so that a run is a run of places.
        u = F.col(unit)
        return F.struct(
            (u["pos"] * 2).alias("at"),
            _n_words(u["text"], F.col("other")).alias("words"),
            u["first"].alias("first"),
            (u["last"] & (F.length(F.trim(u["text"])) > 0)).alias("last"),
        )

    link = F.struct(
        (F.col("pos") * 2 + 1).alias("at"), F.lit(0).alias("words"), F.lit(True).alias("first"), F.lit(False).alias("last")
    )
    marks = F.when(F.col("b").isNull(), F.array(mark("a"))).otherwise(F.array(mark("a"), link, mark("b")))
    met = stored(
        every.join(small, "hash", "left_semi").select(
            "doc_id", "row", "pos", "hash", F.col("b").isNull().alias("single"), body.alias("body"), marks.alias("marks")
        ),
        "repeated-windows",
    )
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row", "pos")
    # Where all windows with a hash were found to be equal, the hash stands for the bytes.
    first = (
        met.groupBy("hash", "single", "body").agg(F.min(place).alias("kept"), F.max(place).alias("end"))
        .groupBy("hash", "single")
        .agg(F.count(F.lit(1)).alias("bodies"), F.min("kept").alias("kept"), F.max("end").alias("end"))
        .where("kept != end")
    )
    first = stored(first, "first-windows")
    found = met.select("doc_id", "row", "pos", "hash", "single", "marks")
    again = found.join(first.where("bodies = 1").select("hash", "single", "kept"), ["hash", "single"])
    again = again.where(place != F.col("kept")).select("doc_id", "row", "marks")
    if shared := first.where("bodies > 1").count():
        several = first.where("bodies > 1").select("hash", "single")
        some = met.join(F.broadcast(several) if shared <= BROADCAST_ROWS else several, ["hash", "single"], "left_semi")
        kept = some.groupBy("hash", "single", "body").agg(F.min(place).alias("kept"))
        more = some.join(kept, ["hash", "single", "body"]).where(place != F.col("kept"))
        again = again.unionByName(more.select("doc_id", "row", "marks"))
    # A set of exploded marks is hashed; array_distinct would compare all marks of a document in pairs.
    placed = (
        again.select("doc_id", "row", F.explode("marks").alias("m"))
        .groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_set("m")).alias("marks"))
    )
    each = placed.select("doc_id", "row", F.posexplode("marks").alias("i", "m"))
    runs = (
        each.groupBy("doc_id", "row", (F.col("m.at") - F.col("i")).alias("run"))
        .agg(
            F.min("m.at").alias("start"),
            F.max("m.at").alias("end"),
            F.sum("m.words").alias("words"),
            # Lines that end in the run, but for one that began before it.
            (F.sum(F.col("m.last").cast("int")) - F.when(F.min_by("m.first", "m.at"), 0).otherwise(1)).alias("whole"),
        )
        .where((F.col("words") > MOST_WORDS) | (F.col("whole") >= LEAST_LINES))
    )
    span = F.struct((F.col("start") / 2).cast("int").alias("first"), (F.col("end") / 2).cast("int").alias("last"))
    return runs.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def passage_dedup(docs: DataFrame) -> DataFrame:
    """All columns of `docs` (`doc_id, text`) without passages that occurred before, and what was removed.

    A passage is a run of units (lines, or sentences of lines of over `LONG_LINE`
    characters) each neighbouring two of which occur earlier, in this order; it
    goes if it has `LEAST_LINES` whole lines or over `MOST_WORDS` words. Lines
    without words don't count. Earlier is a smaller doc_id (null last), of rows
    that share it a smaller hash of the text, and then a place before it in the
    text; so each unit stays at least where it first occurs. Rows equal in doc_id
    and text are one document and end up alike. Null and empty texts stay as they
    are; a text all of which goes becomes empty. Adds `n_lines`, `n_removed`
    (lines of which nothing is left) and `removed` (spans of units from 0).
    Columns of these names are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "removed")
    gone_id, gone_row, spans, left_units = fresh(docs, "_gone_id", "_gone_row", "_spans", "_kept")
    gone = stored(
        repeated_runs(docs).select(F.col("doc_id").alias(gone_id), F.col("row").alias(gone_row), F.col("spans").alias(spans)),
        "removed-runs",
    )
    small = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS // 5 else gone
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_row))
    out = docs.join(small, same, "left")
    removed = F.coalesce(spans, F.array().cast("array<struct<first:int,last:int>>"))
    kept = F.when(
        F.size(removed) > 0,
        F.filter(
            units(F.col("text")),
            lambda u: ~F.exists(spans, lambda s: (u["pos"] >= s["first"]) & (u["pos"] <= s["last"])),
        ),
    )
    out = out.withColumn(left_units, kept)
    before = F.concat(F.array(F.lit(None).cast("int")), F.transform(left_units, lambda u: u["line"]))
    joined = F.array_join(
        F.zip_with(
            left_units,
            F.slice(before, F.lit(1), F.size(left_units)),
            lambda u, line: F.concat(F.when(u["line"] > line, "\n").otherwise(""), u["text"]),
        ),
        "",
    )
    n_lines = F.size(lines(F.col("text")))
    left = F.size(F.array_distinct(F.transform(left_units, lambda u: u["line"])))
    some = F.col(left_units).isNotNull()
    return out.select(
        *[F.when(some, joined).otherwise(F.col(c)).alias(c) if c == "text" else F.col(c) for c in docs.columns],
        n_lines.cast("bigint").alias("n_lines"),
        F.when(some, n_lines - left).otherwise(0).cast("bigint").alias("n_removed"),
        removed.alias("removed"),
    )
