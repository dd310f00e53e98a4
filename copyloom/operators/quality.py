"""Copy checks over generated texts. Every check works inside its row; nothing is shuffled."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyloom import rules
from copyloom.functions.text import let, strip

# Letters, digits and marks of any script: a word may not go on with one of these.
LETTER = r"[\p{L}\p{N}\p{M}_]"

# Any sign that is not white space.
NOT_BLANK = r"[^\s\p{Z}\x{FEFF}]"

ISSUE = "array<struct<check:string,detail:string,n:bigint>>"


def _issue(check: str, detail: Column, n: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"), detail.cast("string").alias("detail"), n.cast("bigint").alias("n")
    )


def _one(check: str, bad: Column, detail: Column, n: Column) -> Column:
    """At most one issue."""
    return F.when(bad, F.array(_issue(check, detail, n)).cast(ISSUE)).otherwise(
        F.array().cast(ISSUE)
    )


def _any_word(words: list[str]) -> str:
    # Longest first, so that no word hides a longer one that begins with it.
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in sorted(words, key=lambda w: -len(w)))


def _times(low: Column, part: Column) -> Column:
    # By bytes: the size of a string is known, its length in characters is not.
    needle = F.lower(part)
    gone = F.octet_length(F.replace(low, needle, F.lit("")))
    return F.floor((F.octet_length(low) - gone) / F.octet_length(needle)).cast("long")


def occurrences(text: Column, part: Column) -> Column:
    """How often `part` occurs in `text`, without regard to case, not overlapping."""
    return _times(F.lower(text), part)


def _each(low: Column, parts: Column, around: str = "") -> Column:
    edge = F.lit(around)
    return F.transform(
        parts,
        lambda p: F.struct(
            p.alias("part"), _times(low, F.concat(edge, p, edge) if around else p).alias("n")
        ),
    )


def occurrences_of_each(text: Column, parts: Column, around: str = "") -> Column:
    """`array<struct<part, n>>`; `around` is put at both ends of each part."""
    return let(F.lower(text), lambda low: _each(low, parts, around))


def _words(low: Column, words: list[str]) -> Column:
    lower = [w.lower() for w in words]
    # The look at the first letter only spares most places the rest of the test.
    firsts = "".join(sorted({re.escape(w[0]) for w in lower}))
    pattern = rf"(?=[{firsts}])(?<!{LETTER})({_any_word(lower)})(?!{LETTER})"
    return let(
        F.regexp_extract_all(low, F.lit(pattern), 1),
        lambda hits: F.transform(
            F.array_distinct(hits),
            lambda w: F.struct(
                w.alias("word"), F.size(F.filter(hits, lambda h: h == w)).cast("long").alias("n")
            ),
        ),
    )


def word_uses(low: Column, parts: Column) -> Column:
    """`array<struct<part, n>>`: how often each part occurs in the lower-cased text, not inside longer words."""

    def uses(part: Column) -> Column:
        quoted = F.replace(F.lower(part), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        edged = F.concat(F.lit(f"(?<!{LETTER})\\Q"), quoted, F.lit(f"\\E(?!{LETTER})"))
        return F.regexp_count(low, edged).cast("long")

    return F.transform(parts, lambda p: F.struct(p.alias("part"), uses(p).alias("n")))


def word_uses_of_each(text: Column, parts: Column) -> Column:
    return let(F.lower(text), lambda low: word_uses(low, parts))


def word_counts(text: Column, words: list[str]) -> Column:
    """`array<struct<word, n>>` of the given words that occur as whole words; one pass."""
    return _words(F.lower(text), words)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def headings(text: Column, lines: Column | None = None) -> Column:
    """`array<struct<pos, level, title>>` of the `#` headings, by 0-based line.

    Here and below, `lines` are the lines of the text where they are at hand.
    """
    parts = F.transform(
        lines_of(text) if lines is None else lines,
        lambda line, i: F.struct(
            i.alias("pos"),
            F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1)).alias("level"),
            F.regexp_extract(line, r"^#{1,6}\s+(.*)$", 1).alias("title"),
        ),
    )
    return F.filter(parts, lambda h: h.level > 0)


def heading_jumps(found: Column, start: int = 1) -> Column:
    """Headings more than one level below the one before; the first is held against `start`."""
    levels = F.concat(F.array(F.lit(start)), F.transform(found, lambda h: h.level))
    pairs = F.zip_with(
        found,
        F.slice(levels, 1, F.size(levels) - 1),
        lambda h, before: F.struct(
            h.title.alias("title"), h.level.alias("level"), before.alias("before")
        ),
    )
    return F.filter(pairs, lambda h: h.level > h.before + 1)


def opens_with(text: Column, phrases: list[str]) -> Column:
    """Does the text begin with one of the phrases, as whole words, emphasis marks aside?"""
    return text.rlike(rf"(?i)^[\s*_]*({_any_word(phrases)})(?!{LETTER})")


def first_paragraph(text: Column, lines: Column | None = None) -> Column:
    """First line that is neither blank nor a heading; NULL if there is none."""
    plain = F.filter(
        lines_of(text) if lines is None else lines,
        lambda l: l.rlike(NOT_BLANK) & ~l.rlike(r"^#{1,6}\s"),
    )
    return F.try_element_at(plain, F.lit(1))


def word_count(text: Column) -> Column:
    words = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(words == "", F.lit(0)).otherwise(F.size(F.split(words, r"\s+"))).cast("long")


def faq_answers(text: Column, faq_title: str = rules.FAQ_HEADING) -> Column:
    """`array<struct<question, words>>` of the FAQ part; NULL where there is none.

    The text is cut at its headings of level 1 and 2; the FAQ part is the first
    piece whose level-2 heading holds the title. Cut at its level-3 headings,
    each piece holds a question and, up to the next deeper heading, its answer.
    """
    parts = F.filter(
        F.split(text, r"\n(?=#{1,2}\s)"),
        lambda p: p.rlike(rf"(?i)^##\s[^\n]*{re.escape(faq_title)}"),
    )
    pieces = F.split(F.try_element_at(parts, F.lit(1)), r"\n###\s")

    def answered(piece: Column) -> Column:
        lines = F.get(F.split(piece, r"\n(?=#{1,6}\s)", 2), F.lit(0))
        question = F.substring_index(lines, "\n", 1)
        answer = F.coalesce(F.get(F.split(lines, "\n", 2), F.lit(1)), F.lit(""))
        return F.struct(strip(question).alias("question"), word_count(answer).alias("words"))

    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), answered)


def covered_categories(text: Column, lines: Column | None = None) -> Column:
    """`array<struct<category, ok>>` of the coverage table's tab separated rows."""
    tabbed = F.filter(lines_of(text) if lines is None else lines, lambda l: l.contains("\t"))
    rows = F.transform(tabbed, lambda l: F.split(l, "\t"))
    known = F.array(*[F.lit(c) for c in rules.FAQ_CATEGORIES])
    named = F.filter(rows, lambda r: F.array_contains(known, strip(r[0])))
    return F.transform(
        named, lambda r: F.struct(strip(r[0]).alias("category"), (strip(r[1]) == "✅").alias("ok"))
    )


def uncovered_categories(table: Column) -> Column:
    """Category names without a row, or whose row is not ✅."""
    wanted = F.array(*[F.lit(c) for c in rules.FAQ_CATEGORIES])
    good = F.transform(F.filter(table, lambda r: r.ok), lambda r: r.category)
    return let(good, lambda g: F.filter(wanted, lambda c: ~F.array_contains(g, c)))


def source_rows(text: Column, heading: str = "📚") -> Column:
    """Lines of the source list: behind its heading, up to the next heading."""
    part = F.regexp_extract(text, rf"(?s)(?:^|\n)##\s*{heading}[^\n]*\n(.*?)(?=\n#{{1,6}}\s|\z)", 1)
    return F.filter(F.split(part, "\n"), lambda l: l.rlike(NOT_BLANK))


def is_source_row(line: Column) -> Column:
    """`name | URL | date`."""
    parts = F.split(line, r"\|")
    return (F.size(parts) == 3) & strip(F.try_element_at(parts, F.lit(2))).rlike("^https?://")


def module_places(text: Column) -> Column:
    """1-based places of the four module headings, 0 where missing."""
    return F.array(
        *[
            F.regexp_instr(text, F.lit(r"(?m)^##\s*" + re.escape(h).replace(r"\ ", r"\s*")))
            for h in rules.MODULE_HEADINGS
        ]
    )


def module_issues(places: Column) -> Column:
    """Missing modules, and the order found where it is not the wanted one."""
    labels = F.array(*[F.lit(h) for h in rules.MODULE_HEADINGS])

    def issues(modules: Column) -> Column:
        missing = F.filter(modules, lambda m: m.at == 0)
        found = F.filter(modules, lambda m: m.at > 0)
        ordered = F.array_sort(found)
        names = F.array_join(F.transform(ordered, lambda m: m.label), "|")
        return F.concat(
            F.transform(missing, lambda m: _issue("module_missing", m.label, F.lit(0))).cast(ISSUE),
            _one("module_order", found != ordered, names, F.size(found)),
        )

    modules = F.zip_with(places, labels, lambda p, h: F.struct(p.alias("at"), h.alias("label")))
    return let(modules, issues)


def check_texts(
    texts: DataFrame,
    banned: dict[str, tuple[str, ...]] | None = None,
    faq_title: str = rules.FAQ_HEADING,
) -> DataFrame:
    """`id, text, keywords` → one row `id, check, detail, n` per violation.

    With a column `whole`, the four modules, the source list and the marks of
    doubt are looked for in it: `text` may be only the page copy of an answer.
    """
    banned = rules.BANNED_WORDS if banned is None else banned
    words = [w for group in banned.values() for w in group]
    category = F.create_map(
        *[F.lit(v) for group, ws in banned.items() for w in ws for v in (w.lower(), group)]
    )
    text = F.col("text")
    kws = F.coalesce("keywords", F.array().cast("array<string>"))
    # Shared intermediate results, computed once per row.
    low = F.col("_low")
    whole = F.col("whole") if "whole" in texts.columns else text
    lines = F.col("_lines")
    base = texts.select(
        "id",
        "text",
        whole.alias("_whole"),
        kws.alias("keywords"),
        F.lower(text).alias("_low"),
        lines_of(text).alias("_lines"),
    ).select(
        "*",
        headings(text, lines).alias("_heads"),
        _words(low, words).alias("_words"),
        first_paragraph(text, lines).alias("_first"),
        covered_categories(text, lines).alias("_table"),
        module_places(F.col("_whole")).alias("_modules"),
        faq_answers(text, faq_title).alias("_faq"),
    )

    heads, faq, table, modules = (F.col(c) for c in ("_heads", "_faq", "_table", "_modules"))
    zero, none = F.lit(0), F.lit(None).cast("string")

    q1 = F.transform(
        "_words", lambda w: _issue("banned_word", F.concat(F.element_at(category, w.word), F.lit(": "), w.word), w.n)
    )
    openers = F.size(
        F.filter(lines, lambda l: l.rlike(rf"(?i)^\s*{rules.BANNED_OPENER}(?!{LETTER})"))
    )
    q1b = _one("banned_opener", openers > 0, F.lit(rules.BANNED_OPENER), openers)

    usable = F.filter("keywords", lambda k: k != "")
    # As whole words a keyword occurs no more often than anywhere: occurrences counted
    # from the left are as many as fit. So few keywords need the look at word edges.
    often = F.filter(usable, lambda k: _times(low, k) > rules.MAX_KEYWORD_USES)
    q2 = F.transform(
        F.filter(word_uses(low, often), lambda u: u.n > rules.MAX_KEYWORD_USES),
        lambda u: _issue("keyword_overused", u.part, u.n),
    )
    bold = _each(low, usable, "**")
    q3 = F.transform(
        F.filter(bold, lambda u: ~u.n.between(1, rules.MAX_KEYWORD_BOLD)),
        lambda u: _issue("keyword_bold", u.part, u.n),
    )

    tops = F.size(F.filter(heads, lambda h: h.level == 1))
    q4 = F.concat(
        _one("h1_used", tops > 0, none, tops),
        F.transform(heading_jumps(heads), lambda h: _issue("heading_jump", h.title, h.level)),
    )
    phrases = [*rules.BANNED_FIRST_PHRASES, *words, rules.BANNED_OPENER]
    q5 = _one("opening", opens_with(F.col("_first"), phrases), F.col("_first"), F.lit(1))
    q6 = F.when(faq.isNull(), F.array(_issue("faq_missing", none, zero)).cast(ISSUE)).otherwise(
        _one("faq_count", ~F.size(faq).between(rules.MIN_FAQ, rules.MAX_FAQ), none, F.size(faq))
    )
    q7 = F.transform(
        F.filter(
            F.coalesce(faq, F.array().cast("array<struct<question:string,words:bigint>>")),
            lambda a: ~a.words.between(rules.MIN_ANSWER_WORDS, rules.MAX_ANSWER_WORDS),
        ),
        lambda a: _issue("answer_length", a.question, a.words),
    )
    q8 = F.transform(uncovered_categories(table), lambda c: _issue("faq_category", c, zero))
    q9 = module_issues(modules)
    q10 = F.transform(
        F.filter(source_rows(F.col("_whole")), lambda l: ~is_source_row(l)), lambda l: _issue("source_row", l, F.lit(1))
    )
    marks = occurrences(F.col("_whole"), F.lit(rules.UNVERIFIED_MARK))
    q11 = _one("unverified", marks > 0, none, marks)
    count = F.size(usable)
    q12 = _one("keyword_count", ~count.between(rules.MIN_KEYWORDS, rules.MAX_KEYWORDS), none, count)

    issues = F.concat(*[q.cast(ISSUE) for q in (q1, q1b, q2, q3, q4, q5, q6, q7, q8, q9, q10, q11, q12)])
    return base.select("id", F.inline(issues))
