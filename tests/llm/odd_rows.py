"""Tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

DOCS = "doc_id bigint, text string, lang string, source string, row string, hash string, kept string, id string"

LONG = "long " * 30_000 + "\n" + "x" * 50_000


def docs(spark, rows=None, seed_rows=()):
    rows = ROWS if rows is None else rows
    return spark.createDataFrame(
        [(i, t, lang, None, "r", None, "k", "9") for i, t, lang in [*rows, *seed_rows]], DOCS
    )


ROWS = [
    (1, "The same text twice. It has more than five words.", "en"),
    (2, "The same text twice. It has more than five words.", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, LONG, "en"),
    (6, "one", None),
    (7, "ünïcödé ωørds　with odd\x1cspace \x00 and  gaps\n\n\nhere 😀", "de"),
    (8, "?! ... 123", ""),
    (9, "   \n\t ", "fr"),
    (-3, "a b c d", "en"),
    (None, "a row without an id", "en"),
    (10, "twice the same row, all of it", "en"),
    (10, "twice the same row, all of it", "en"),
]


def empty(spark):
    return spark.createDataFrame([], DOCS)
